"""Exact dedup, prefix tries and spelling variants against brute force, and their edges."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from transcripta.llm import exact_dedup, prefix_trie, spelling

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lowered(text):
    return (text or "").encode().translate(LOWER)


# Exact dedup


@pytest.mark.parametrize(("entries", "bits"), [(0, 20), (1, 20), (500, 10), (1000, 60), (5000, 13)])
def test_filter_gives_back_what_went_in(entries, bits):
    rng = np.random.default_rng(entries)
    prints = np.unique(rng.integers(0, 1 << bits, entries, dtype=np.uint64))
    counts = rng.choice([1, 1, 2, 3, 70000], len(prints)).astype(np.int64)
    found = exact_dedup.entries_of(exact_dedup.filter_of(prints, counts, bits), bits)
    assert found[0].tolist() == prints.tolist() and found[1].tolist() == counts.tolist()


def plain_copies(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(lowered(text), []).append(key)
    return sorted((d, max(g), len(g), d == max(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for d in g)


@pytest.mark.parametrize("bits", [64, 5])
def test_copies_equal_brute_force_whatever_collides(spark, bits):
    rng = random.Random(1)
    rows = [(k, rng.choice(["", None, "Ab", "aB", "ab ", "Ä", "ä", "x" * 70000, f"one of a kind {k}", f"two of a kind {k // 2}"])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, exact_dedup.copies(docs, bits=bits).collect())) == plain_copies(rows)


def test_merged_filters_count_across_partitions_and_batches(spark):
    prints = [1 << 60, 1 << 60, 5, 7, 7, (1 << 63) - 1]
    rows = spark.createDataFrame([(p,) for p in prints], "fingerprint long").repartition(3)
    stored = exact_dedup.merged(exact_dedup.filters(rows, 4), 4)
    later = exact_dedup.filters(spark.createDataFrame([(5,), (9,)], "fingerprint long"), 4)
    found = exact_dedup.repeated(exact_dedup.merged(stored.unionByName(later), 4), 4)
    assert {tuple(r) for r in found.collect()} == {(1 << 60, 2), (5, 2), (7, 2)}


def test_copies_edges(spark):
    rows = [(1, "a"), (1, "A"), (None, "b"), (None, "B"), (None, "q"), (7, "q"), (None, "alone")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, keep_id string, n int")
    found = [tuple(r)[:4] for r in exact_dedup.copies(docs).collect()]
    want = [(1, 1, 2, True), (1, 1, 2, False), (None, None, 2, True), (None, None, 2, False), (None, 7, 2, False), (7, 7, 2, True), (None, None, 1, True)]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert exact_dedup.copies(docs.limit(0)).count() == 0


# Prefix tries


def turn_order(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(b"%d:%s%s" % (len(role), role, text)).digest()[:16]


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0, turn_order(role, text)), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members, children, sums, out = {}, {}, {}, []
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        sums[node] = ((len(members[node]) - 1) * words + sum(sums[x][0] for x in below), sum(sums[x][1] for x in below) if below else 1)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(full[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), sums[node][1], sums[node][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(conversations, **options):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[c] for c in names) for r in prefix_trie.prefix_trie(conversations, **options).collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def drawn_turns(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice([0, 1, 2, 3, 5, 20, 21, 41, 45, None, 60]), rng.choice([None, 0, 1, 2, 3, 4, 5]), rng.choice([None, "", "user", "a"]), rng.choice([None, "", "x y", "x  z", " w"])) for _ in range(n)]


def test_trie_equals_brute_force(spark):
    rows = drawn_turns(3)
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain_trie(rows)


def test_trie_of_a_conversation_over_all_partitions(spark):
    rows = [(20, k, "u", f"turn {k}") for k in range(500)] + [(23, k, "u", f"turn {k}") for k in range(450)] + [(21, 0, "u", "")] * 3
    conversations = spark.createDataFrame(rows, SCHEMA)
    places = prefix_trie.stored_turns(conversations).where("conv_id = 20").select("pos", "until").collect()
    assert sorted(map(tuple, places)) == [(k + 1, 2 * (k + 1)) for k in range(500)]
    assert trie(conversations) == plain_trie(rows)


def test_clashing_fingerprints_start_again(spark):
    rows = drawn_turns(4)
    conversations = spark.createDataFrame(rows, SCHEMA)
    weak = prefix_trie.Seed(0, (5, 7, 11, 13))
    assert trie(conversations, attempts=(weak, prefix_trie.Seed(1))) == plain_trie(rows)
    with pytest.raises(ArithmeticError):
        trie(conversations, attempts=(prefix_trie.Seed(0, (2, 2, 2, 2)),))


def test_trie_edges(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, 0, "u", "a b")]
    assert trie(spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, depth int, n string")) == plain_trie(rows)


# Spelling variants


def plain_words(rows, least_length=7, least_seen=2):
    seen = Counter()
    for key, text in rows:
        for word in re.findall("[a-zÀ-ÿ]+", lowered(text).decode()):
            drawn = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if drawn % 31 == 0:
                word = word[: drawn % len(word)] + word[drawn % len(word) + 1 :]
            seen[word] += 1
    return {w: n for w, n in seen.items() if len(w) >= least_length and n >= least_seen}


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: set() for w in words}
    groups = {}
    for w in words:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            groups.setdefault((k, short), []).append(w)
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for group in groups.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root(w)) for w, n in words.items()}


def drawn_texts(seed, docs=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdéÿß") for _ in range(rng.choice([7, 7, 8, 9, 50]))) for _ in range(30)]
    rows = []
    for k in range(docs):
        words = []
        for stem in rng.choices(stems, weights=[30 if j < 4 else 1 for j in range(30)], k=120):
            at = rng.randrange(len(stem))
            words.append(rng.choice([stem] * 6 + [stem[:at] + stem[at + 1 :], stem[:at] + "a" + stem[at:], stem[:at] + rng.choice("abcÿ") + stem[at + 1 :], stem.upper()]))
        rows.append((k, rng.choice([" ", ", ", "1"]).join(words)))
    return [*rows, (None, rows[0][1]), (99, None), (98, "")]


@pytest.mark.parametrize("filter_words", [spelling.FILTER_WORDS, 16])
def test_variants_equal_brute_force_with_any_number_of_passes(spark, filter_words):
    rows = drawn_texts(5)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs, filter_words=filter_words).collect()}
    assert found == plain_variants(rows)


def test_a_filter_holds_all_its_words_and_few_others(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(7, 12))) for _ in range(4000)})
    inside = spelling._Words(words[::2])
    outside = spelling._Words(words[1::2])
    plan = spelling.Plan(dict(Counter(min(len(w), spelling.LONG) for w in words[::2])), 1 << 12)
    rows = spark.createDataFrame([(w, 2) for w in words[::2]], "word string, n long")
    held = np.zeros(2, dtype=int)
    for at in plan.passes:
        bits = spelling.bloom(rows, plan, at, 1 << 12)
        for k, block in enumerate((inside, outside)):
            keys = spelling._keys(block.hash, block.length)
            spot = plan.spots(at, keys, spelling._shard(block.length))
            held[k] += sum(bool(s >= 0 and bits[2 * s] & m == m and bits[2 * s + 1] & a == a) for s, m, a in zip(spot, spelling._mask(keys), spelling._mask(spelling._again(keys))))
    assert held[0] == len(inside.words) and held[1] < 0.01 * len(outside.words)


def test_long_texts_are_counted_in_pieces(spark):
    text = ("Wörterbuch " * 7 + "x" * 300000 + "-Encyclop ") * 8
    rows = [(1, text), (2, text)]
    found = {r.word: r.n for r in spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == plain_words(rows)


def test_variants_edges(spark):
    docs = spark.createDataFrame([(1, "too few long enough"), (2, None)], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0 and spelling.variants(docs.limit(0)).count() == 0
    chain = [(k, f"{'programme ' * 200}{'programma ' * 15}{'programmas'}") for k in range(3)]
    found = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert found == {w: (v[2], v[4]) for w, v in plain_variants(chain).items()} and found["programmas"] == ("programma", "programme")
