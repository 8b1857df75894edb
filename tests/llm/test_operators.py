"""The ten operators against brute force, and their edge cases."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from transcripta.llm import decontaminate, html_text, jaccard_join, license_scan, line_dedup, mixing, pii, quality_fm, topk, warc_fixity
from transcripta.llm.shared import components
from transcripta.operators import scratch

SMALL = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, start=0):
    """Documents of these texts, with a null and an empty one, a repeated row and clashing columns."""
    rows = [(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def extra(docs):
    """Columns whose names are those that the operators use within."""
    return docs.selectExpr("*", "'x' as id", "1 as n", "'k' as kept_0", "2L as cls", "0 as pos", "'l' as line", "3 as score_", "'t' as topic_")


def vocabulary(seed, size=400):
    rng = random.Random(seed)
    return rng, ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(size)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def plain_contamination(docs, items, window=10):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))

    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


@pytest.mark.parametrize("short", [False, True])
def test_contamination_is_that_of_brute_force(spark, short, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 150)  # several blocks
    rng, v = vocabulary(2, 60)
    items = [(k, " ".join(rng.choices(v, k=rng.choice([3, 12, 25] if short else [12, 25])))) for k in range(20)] + [(90, None), (91, "!!")]
    items += [(92, items[0][1]), (93, " ".join(["aa"] * 14))]
    texts = [None, "", "...", "É" * 5, " ".join(["AA"] * 40)]
    for _ in range(40):
        w = rng.choices(v, k=rng.randint(1, 60))
        own = rng.choice(items)[1] or ""
        at = rng.randint(0, len(w))
        texts.append(rng.choice([" ", ", ", "\n"]).join([*w[:at], *own.upper().split()[: rng.randint(1, 25)], *w[at:]]))
    docs = extra(frame(spark, texts))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.contamination(docs, table, keep=["doc_id"]).collect()}
    assert got == plain_contamination(list(enumerate(texts)), items)
    assert any(x[1] for x in got.values())
    kept = decontaminate.decontaminated(docs, table, most_coverage=0.9)
    assert kept.columns == docs.columns
    clean = [(r.doc_id, r.text) for r in kept.collect()]
    assert {d: t for d, t in clean if not got[d][1]} == {d: texts[d] for d, _ in clean if not got[d][1]}
    assert {d for d, x in got.items() if not x[1]} <= {d for d, _ in clean}
    assert decontaminate.contamination(docs.limit(0), table, keep=["doc_id"]).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs, table.limit(0), keep=["doc_id"]).collect())


# 2


def test_quality_is_learned_and_scores_everything(spark):
    rng, v = vocabulary(3)
    texts, labels = [], []
    for k in range(300):
        good = rng.random() < 0.7
        w = rng.choices(v, k=rng.randint(5, 60))
        texts.append((" ".join(w) + ".") if good else " ".join(x.upper() + "!!" for x in w))
        labels.append((k, int(good), 0))
    docs = extra(frame(spark, [*texts, None, ""]))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_fm.fit(docs, table, train="id % 3 <> 1")
    got = {r.doc_id: r.score for r in quality_fm.scored(docs, model, keep=["doc_id"]).collect()}
    held = [k for k in range(300) if k % 3 == 1]
    assert np.mean([(got[k] >= 0.5) == bool(labels[k][1]) for k in held]) > 0.95
    assert len(got) == 302 and all(0 <= x <= 1 for x in got.values())
    # the linear-time form is the sum over all pairs
    x = np.concatenate([rng_array(0, 4), np.zeros(quality_fm.BUCKETS - 4), rng_array(1, quality_fm.STATISTICS)])
    m = quality_fm.Model(0.3, np.linspace(-1, 1, len(x)), np.random.default_rng(5).normal(0, 0.1, (len(x), quality_fm.RANK)), np.zeros(quality_fm.STATISTICS), np.ones(quality_fm.STATISTICS))
    some = np.flatnonzero(x)
    pairs = sum(float(m.factors[i] @ m.factors[j]) * x[i] * x[j] for i, j in combinations(some, 2))
    want = 1 / (1 + np.exp(-(m.bias + m.weights @ x + pairs)))
    have = quality_fm._outputs(m, 1, np.zeros(4, dtype=int), np.arange(4), x[:4], x[None, quality_fm.BUCKETS :])
    assert abs(have[0] - want) < 1e-9
    nothing = quality_fm.fit(docs, table.limit(0))
    assert {round(r.score, 6) for r in quality_fm.scored(docs, nothing, keep=[]).collect()} == {0.5}


def rng_array(seed, size):
    return np.random.default_rng(seed).uniform(-1, 1, size)


# 3


def test_license_base_places_are_those_of_brute_force(spark):
    texts = [
        None,
        "",
        "released under the MIT-License. Licensed under the Apache License, Version 2.0! mit  license",
        "GNU general public LICENSE version 3; this work is licensed under the GNU General Public License, version 3.",
        "permit license; mit licenses; general public; license",
        "license " * 300 + "apache license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ]
    docs = extra(frame(spark, texts)).unionByName(extra(frame(spark, texts[2:3], start=2)))
    rows = license_scan.license_scan(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (texts[r.doc_id] or "").translate(LOWER))
        places = sorted((i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in rows}
    assert by[2].labels == "Apache-2.0,MIT,apache,mit" and "GPL-3.0" in by[3].labels and by[6].labels == "BSD" and by[4].labels == "gpl"
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def test_a_notice_that_all_documents_share_is_found(spark):
    docs = frame(spark, ["this code is released under the MIT license"] * 4)
    assert {(r.labels, r.score) for r in license_scan.license_scan(docs).collect()} == {("MIT,mit", 1.0)}


def test_identifiers_and_short_names_are_found(spark):
    texts = ["// SPDX-License-Identifier: GPL-2.0-only", "# SPDX-License-Identifier: Apache-2.0", "free software under the GNU GPL v3", "SPDX identifiers are listed elsewhere"]
    found = {r.doc_id: r.labels for r in license_scan.license_scan(frame(spark, texts)).collect()}
    assert found == {0: "GPL-2.0", 1: "Apache-2.0", 2: "GPL-3.0", 3: ""}


def test_licenses_of_several_notices_are_all_found(spark):
    rng, v = vocabulary(33)
    every = license_scan.TEMPLATES
    chosen = [(1, 7), (1, 2, 7, 10), (3, 7, 10), tuple(range(len(every)))]
    texts = [" filler words ".join(every[t][1] for t in ts) for ts in chosen] + [" ".join(rng.choices(v, k=30)) for _ in range(200)]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, texts)).collect()}
    for d, ts in enumerate(chosen):
        assert {every[t][0] for t in ts} == set(got[d].labels.split(",")) - {label for _, label in license_scan.BASE}
        assert got[d].score >= license_scan.LEAST_SCORE
    assert all(got[d].labels == "" for d in range(len(chosen), len(texts)))


# 4


def test_raking_meets_its_targets_on_both_ways(spark):
    rows = [(k, ["a b c", "a", "longword x", None, ""][k % 5], ["en", "de", None][k % 3], "hot" if k % 3 else f"s{k % 4}", 1) for k in range(400)]
    docs = extra(spark.createDataFrame(rows, DOCS))
    targets = {"source": 0.5, "lang": {"en": 3.0, "de": 1.0, "": 1.0}, "topic": 0.5}
    cells = mixing.mixed(docs, targets).groupBy(*mixing.DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    here, apart = (mixing.raked(cells, targets, 20, most).toPandas() for most in (1000, 0))
    for d, share in (("lang", {"en": 0.6, "de": 0.2, "": 0.2}),):
        got = here.groupby(d)["weight"].sum() / here["weight"].sum()
        assert all(abs(got[k] - v) < 0.02 for k, v in share.items())
    a, b = (x.sort_values(list(mixing.DIMENSIONS))["weight"].to_numpy() for x in (here, apart))
    assert np.allclose(a, b)
    kept = mixing.sampled(docs, share=1.0)
    assert kept.columns == docs.columns and 0 < kept.count() <= 400
    report = mixing.mixed(docs, share=1.0).collect()
    assert {r.doc_id for r in report if r.sampled} == {r.doc_id for r in kept.collect()}
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_sampled_shares_meet_the_targets(spark):
    import corpus_pipeline

    rows = [(k, "a b c", "en" if k % 8 else "es", "s", 5) for k in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    target = 500**0.5 / (500**0.5 + 3500**0.5)
    kept = Counter(r.lang for r in corpus_pipeline.mixture(spark, docs, SMALL).collect())
    assert abs(kept["es"] / sum(kept.values()) - target) < 0.02 and kept["es"] == 500


# 5


def plain_components(texts, n, percent, pattern):
    sets = {}
    for d, text in texts:
        w = re.findall(pattern, (text or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(seed=4):
    rng, v = vocabulary(seed)
    base = [rng.choices(v, k=rng.choice([3, 20, 80, 200])) for _ in range(25)]
    texts = [None, "", "...", "One two", "one TWO", " ".join(["same"] * 50), " ".join(["same"] * 90)]
    for _ in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(v)
        texts.append(" ".join(w if rng.random() < 0.8 else w[: rng.randint(1, len(w))]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("n", "percent", "words", "pattern"), [(4, 85, "spaced", r"[^\x20\x09-\x0d]+"), (5, 80, "alnum", "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")])
def test_jaccard_components_are_those_of_brute_force(spark, n, percent, words, pattern):
    texts = near_copies(n)
    docs = extra(frame(spark, texts)).repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, n=n, percent=percent, words=words).collect()}
    assert got == plain_components(list(enumerate(texts)), n, percent, pattern)


def test_jaccard_of_nothing(spark):
    empty = frame(spark, [None, ""])
    assert {(r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(empty).collect()} == {(0, 0), (0, 1)}
    assert jaccard_join.jaccard_components(empty.limit(0)).count() == 0


# 6


def test_fuzzy_lines_are_found_and_others_stay(spark):
    rng, v = vocabulary(6)
    lines = [" ".join(rng.choices(v, k=rng.randint(10, 25))) for _ in range(60)]
    docs = []
    for _ in range(50):
        own = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(lines)
            if rng.random() < 0.5:
                at = rng.randrange(len(line))
                line = f"{line[:at]}~{line[at + 1 :]}"
            own.append(f"  {line.upper()} " if rng.random() < 0.2 else line)
        docs.append("\n".join([*own, "short", "short"]))
    docs += [None, "", "\n\n", docs[0]]
    rows = line_dedup.line_deduplicated(extra(frame(spark, docs))).collect()
    assert len(rows) == len(docs)

    def grams(x):
        return {x[i : i + 5] for i in range(len(x) - 4)} if len(x) >= line_dedup.FUZZY_CHARS else {x}

    places, parent = [], {}
    for d, text in enumerate(docs):
        for p, line in enumerate((text or "").split("\n")):
            if len(line.strip()) >= line_dedup.LEAST_CHARS:
                places.append((d, p, grams(line.strip(" ").lower())))
    parent = {(d, p): (d, p) for d, p, _ in places}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (d, p, a), (e, q, b) in combinations(places, 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find((d, p)), find((e, q))))
            parent[y] = x
    missed = wrong = 0
    for r in rows:
        text = docs[r.doc_id]
        if text is None:
            assert r.kept_text is None and r.n_lines == 0
            continue
        want = [x for p, x in enumerate(text.split("\n")) if (r.doc_id, p) not in parent or find((r.doc_id, p)) == (r.doc_id, p)]
        have = r.kept_text.split("\n")
        missed += r.n_lines - r.n_dropped > len(want)
        wrong += not set(want) <= set(have)
    assert wrong == 0 and missed <= 2
    assert line_dedup.line_deduplicated(frame(spark, docs).limit(0)).count() == 0


def test_lines_that_share_a_band_are_linked_as_by_brute_force(spark):
    rng, _ = vocabulary(16)
    lines = []
    for _ in range(60):
        stem = "https://exam" + "".join(rng.choice("abcdefghijklmnop") for _ in range(40))
        lines += [f"{stem}ab", f"{stem}cd"]
    # a chain: its ends resemble only their neighbours
    chain = "".join(rng.choice("abcdefghijklmnop") for _ in range(60))
    for k in range(12):
        chain = f"{chain[4:]}{''.join(rng.choice('abcdefghijklmnop') for _ in range(4))}"
        lines.append(chain)
    texts = spark.createDataFrame(list(enumerate(lines)), "lh long, line string")
    got = {r.node: r.component for r in line_dedup._linked(texts.selectExpr("lh", "1L as key"), texts.selectExpr("lh", "array(0L) sw", "array(0L) sc"), lambda wanted: texts, 80).collect()}
    grams = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(lines)), 2):
        if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert len({find(k) for k in parent}) == 61
    assert [got.get(k, k) for k in range(len(lines))] == [find(k) for k in range(len(lines))]


def test_lines_without_blanks_and_of_few_words_find_their_partners(spark):
    rng = random.Random(26)

    def drawn(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    han, latin = [chr(c) for c in range(0x4E00, 0x5000)], "abcdefghijklmnopqrstuvwxyz0123456789"
    pairs = []
    for _ in range(50):
        a = drawn(han, 80)
        pairs.append((a, f"{a[:3]}~{a[4:]}"))
        a = drawn(latin, 40)
        pairs.append((f"https://example.org/{a}x", f"https://example.org/{a}yz"))
        a = " ".join(drawn(latin, 8) for _ in range(rng.randint(2, 3)))
        pairs.append((f"{a} end", f"{a} eng"))
    docs = frame(spark, [x for pair in pairs for x in pair])
    dropped = {r.doc_id for r in line_dedup.dropped_lines(docs).collect()}
    # every first line of a pair stays; 1 in 100 partners may be missed
    assert dropped <= set(range(1, 2 * len(pairs), 2)) and len(dropped) >= 0.99 * len(pairs)


def test_no_similar_lines_are_left_out_whatever_their_signatures(spark):
    rng, grams = random.Random(31), lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    lines = []
    while len(lines) < 1600:
        # one changed place in lines of few shingles, more in longer ones, until they are just similar
        a = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(rng.choice((5, 12, 13, 14, 20, 40))))
        b = a
        while True:
            at = rng.randrange(len(b))
            c = f"{b[:at]}{rng.choice('qrstuv')}{b[at + 1:]}"
            if 100 * len(grams(a) & grams(c)) < 80 * len(grams(a) | grams(c)):
                break
            b = c
        if a != b:
            lines += [a, b]
    dropped = {r.doc_id for r in line_dedup.dropped_lines(frame(spark, lines)).collect()}
    assert dropped == set(range(1, len(lines), 2))


def test_short_lines_are_compared_like_others(spark):
    rng, lines, grams = random.Random(54), [], lambda x: {x[i : i + 5] for i in range(max(len(x) - 4, 1))}
    for n in range(4, 20):
        for _ in range(4):
            a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
            # one more letter: similar from four shingles on
            lines += [a, f"{a}~"]
    want = {k for k in range(1, len(lines), 2) if 100 * len(grams(lines[k]) & grams(lines[k - 1])) >= 80 * len(grams(lines[k]) | grams(lines[k - 1]))}
    assert 0 < len(want) < len(lines) / 2
    assert {r.doc_id for r in line_dedup.dropped_lines(frame(spark, lines)).collect()} == want


def test_similar_sizes_meet_in_a_level_with_keys_enough(spark):
    for percent in (60, 80, 95):
        levels = {}
        for r in spark.range(1, 3000).toDF("n").select("n", F.inline(line_dedup._levels(percent))).collect():
            levels.setdefault(r.n, {})[r.level] = (r.parts, r.made)
        for n in (*range(1, 400), *range(400, 2999, 97)):
            for t in range(n, min(2999, 100 * n // percent) + 1):
                differ = (n + t) * (100 - percent) // (100 + percent)
                both = set(levels[n]) & set(levels[t])
                # more parts than may differ, and so many keys of either set
                assert any(levels[n][k][0] == levels[t][k][0] > differ < min(levels[n][k][1], levels[t][k][1]) for k in both), (percent, n, t)
    # few keys are made in one pass
    assert len(line_dedup._passes(spark.range(20, 2000).toDF("n"), 80)) == 1


def test_a_pass_takes_all_lines_of_its_levels(spark):
    lines = spark.range(1, 3000).toDF("n")
    whole = lines.select("n", F.explode(line_dedup._levels(80).level).alias("level")).groupBy("level").agg(F.count("*").alias("c")).collect()
    assert len(whole) > 10 and all(line_dedup._sized(lines, (r.level, r.level), 80).count() == r.c for r in whole)


def test_tables_of_lines_go_once_they_are_read(spark):
    rng, v = vocabulary(52)
    lines = [" ".join(rng.choices(v, k=20)) for _ in range(40)]
    with scratch.noted() as made:
        gone = line_dedup.dropped_lines(frame(spark, [*lines, *(f"{x}!" for x in lines)]))
    assert len(made) > 10 and {Path(x).name.rsplit("-", 1)[0] for x in made if Path(x.removeprefix("file:")).exists()} == {"lines", "line-keeps"}
    assert {r.doc_id for r in gone.collect()} == set(range(40, 80))


def test_blocks_that_note_equal_tables_end_by_themselves(spark):
    with scratch.noted() as outer:
        with scratch.noted() as inner:
            scratch.settled(spark.range(1), "one")
        scratch.settled(spark.range(1), "two")
    assert (len(inner), len(outer)) == (1, 2)


def test_long_lines_meet_those_that_are_just_similar_alone(spark):
    rng, v = vocabulary(53)
    lines = []
    for _ in range(30):
        a = [rng.choice(v) + str(rng.randrange(99)) for _ in range(400)]
        b = list(a)
        grams = {x[i : i + 5] for x in (" ".join(a),) for i in range(len(x) - 4)}
        while True:
            c = list(b)
            c[rng.randrange(400)] = rng.choice(v) + str(rng.randrange(99))
            other = {x[i : i + 5] for x in (" ".join(c),) for i in range(len(x) - 4)}
            if 100 * len(grams & other) < 80 * len(grams | other):
                break
            b = c
        lines += [" ".join(a), " ".join(b)]
    texts = spark.createDataFrame(list(enumerate(lines)), "lh long, line string")
    sets = line_dedup._sets(texts, spark.createDataFrame([], "node long, component long"))
    assert sets.where(f"n > {line_dedup.LARGE}").count() == len(lines)
    every = sets.selectExpr("lh").crossJoin(sets.selectExpr("lh leader")).where("lh < leader")
    twins = {(k, k + 1) for k in range(0, len(lines), 2)}
    assert {(r.lh, r.leader) for r in line_dedup._closer(every, sets, 80).collect()} == twins
    assert {tuple(sorted(r)) for r in line_dedup._across(sets, 80).collect()} == twins
    assert {r.doc_id for r in line_dedup.dropped_lines(frame(spark, lines)).collect()} == set(range(1, len(lines), 2))


# 7


def test_personal_data(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    texts = [
        None,
        "",
        "write to é.bob.x+y@mail.example.org, or a@@b.cc or @c.dd; x@y.zz@q.rr",
        "hosts 10.0.0.1 1.2.3.4.5.6.7.8 256.1.1.1 " + "9" * 6000 + ".1.1.1",
        "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111",
        "call +49 (30) 123-4567 or +1 2 or +1234567890123456",
        f"bank account {iban}, version 078-05-1120, " + "and so on " * 9 + "ssn 078-05-1120",
        "a" * 100_000,
    ]
    rows = {r.doc_id: r for r in pii.digest(pii.personal_data(extra(frame(spark, texts)))).collect()}
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert [s for s in rows[2].spans.split(",") if s] == [f"email:{m.start()}:{m.end()}" for m in email.finditer(texts[2])]
    assert (rows[3].n_ip, rows[4].n_card, rows[5].n_phone) == (3, 2, 1)
    assert rows[3].spans.startswith("ip:6:14,ip:15:22,ip:23:30")
    assert f"iban:{texts[6].index('DE')}:{texts[6].index('DE') + len(iban)}" in rows[6].spans and rows[6].spans.count("ssn") == 1
    assert rows[6].base_sha256 == hashlib.sha256(b"").hexdigest() == rows[7].base_sha256
    masked = {r.doc_id: r.text for r in pii.redacted(frame(spark, texts)).collect()}
    assert masked[0] is None and masked[4].startswith("card <card>, ") and masked[7] == texts[7]


# 8


def test_fixity_audit_finds_each_damage(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k % 50}", f"<p>{k}</p>" if k % 7 else None) for k in range(900)] + [(5, "http://h/5", "<p>5</p>"), (None, None, None)], "page_id long, url string, html string").repartition(5)
    second = pages.where("page_id is null or page_id not in (13, 300)").withColumn("html", F.when(F.col("page_id").isin(21, 700), "rot").otherwise(F.col("html"))).unionByName(spark.createDataFrame([(2000, "u", "x")], pages.schema))
    got = warc_fixity.audit(pages, second, shard_records=60).collect()
    assert sorted((r.page_id, r.status) for r in got) == [("13", "missing"), ("2000", "extra"), ("21", "changed"), ("300", "missing"), ("700", "changed")]
    assert all((r.offset is None) == (r.status == "extra") for r in got)
    once = pages.dropDuplicates(["page_id"])
    assert [(r.page_id, r.status) for r in warc_fixity.audit(pages, once).collect()] == [("5", "changed")]
    assert warc_fixity.audit(pages, pages.repartition(3)).count() == 0
    assert warc_fixity.audit(pages.limit(0), pages.limit(0)).count() == 0


# 9


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav>Home</nav><article><h1>T</h1><p>One &amp; <b>two<br>three<p>four&nbsp; five</article><footer>f</footer>", "T\nOne & two three\nfour five"),
        ('<article><p>Text</p><div class="comments"><p>First!</p></div><aside>x</aside><form>y</form><script>var t="</p>"</script><p>End', "Text\nEnd"),
        ("<p>" + "the cat is on the mat and it was for the best of them " * 6 + "</p><p>and so on</p><div><a href=x>a link list</a></div>", ("the cat is on the mat and it was for the best of them " * 6).strip() + "\nand so on"),
        ("<!-- <article>no</article> -->" + "<div>" * 3000 + "</div>" * 3000, ""),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


PROSE = ("the cat is on the mat and it was for the best of them " * 6).strip()
HAN = "".join(chr(0x4E00 + 7 * k % 500) for k in range(260))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # the body in plain divs, teasers as articles
        (f"<div><p>{PROSE}</p></div><article><a href=x>Read this next</a></article><article><h3>Other news</h3></article>", PROSE),
        # text in an article, short and linked blocks outside it
        (f"<div>Latest</div><main><h1>T</h1><p>{PROSE}</p></main><div><a href=x>all of this is linked</a></div>", f"T\n{PROSE}"),
    ],
)
def test_main_text_by_blocks_inside_and_outside_articles(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article class="post has-sidebar"><p>{PROSE}</p></article>', PROSE),
        (f'<main id="search-results"><p>{PROSE}</p></main>', PROSE),
        (f'<div class="content no-sidebar"><p>{PROSE}</p></div><div class="site-footer">foot</div>', PROSE),
        (f'<div class="search"><main><p>{PROSE}</p></main></div>', PROSE),
        (f"<div><p>{HAN}</p></div>", HAN),
        (f"<p>{PROSE}</p><pre>{'x = call(y); ' * 20}</pre><p>{PROSE}</p>", f"{PROSE}\n{('x = call(y); ' * 20).strip()}\n{PROSE}"),
    ],
)
def test_main_text_keeps_whole_articles(page, text):
    assert html_text.main_text(page) == text


LIST = "<ul><li><a href=a>One page</a><li><a href=b>Another page</a><li><a href=c>A third page</a></ul>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # rules reject blocks inside articles: rows of links, several links, long links, stop-poor linked ones
        (f"<article><p>{PROSE}</p>{LIST}<p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}"),
        (f"<article><p>{PROSE}</p><p><a href=x>Home</a> | <a href=y>About us</a></p><p><a href=z>The paper</a></p><p>{PROSE}</p></article>", f"{PROSE}\nThe paper\n{PROSE}"),
        (f"<article><p>{PROSE}</p><p><a href=x>{'Breaking news headline teaser ' * 5}</a></p></article>", PROSE),
        (f"<article><p>{PROSE}</p><p>{'Sponsored gadget offers ' * 5}<a href=x>{'buy gadgets ' * 4}</a></p><p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}"),
        # marks of layout on wrappers
        (f'<body><div class="right-sidebar"><article><p>{PROSE}</p></article></div></body>', PROSE),
        (f'<article><p>{PROSE}</p></article><div class="sidebar"><article><p>teaser {PROSE}</p></article></div>', PROSE),
        (f'<div class="comments"><article><p>{PROSE}</p></article></div>', ""),
        (f'<nav class="menu"><article><p>{PROSE}</p></article></nav>', ""),
        # headers inside articles
        (f'<article><div class="post-header"><h1>Top</h1></div><h2 class="section-header">Head</h2><p>{PROSE}</p></article>', f"Top\nHead\n{PROSE}"),
    ],
)
def test_main_text_rejects_inside_articles_and_keeps_wrapped_ones(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("piece", ["<script ", "<a \"", "<a '", "<!-- ", "<style>", "<p <b ", "&amp", "<div>"])
def test_pages_take_time_in_proportion(piece):
    began = time.perf_counter()
    html_text.main_text(piece * 40_000)
    assert time.perf_counter() - began < 5


# 10


def test_top_k_is_that_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(8)
    vectors = [(int(k), [float(x) for x in rng.normal(0, 1, 40) * rng.choice([0.01, 1, 30])]) for k in range(600)]
    vectors += [(700, None), (701, [float("nan")] * 40), (702, [None] * 40), (703, [1.0, 2.0]), (704, []), (800, [0.0] * 40), (900, [1.0, 1.0]), (1, vectors[1][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect()}
    whole = [(k, np.floor(np.array(v) * 1024).astype(np.int64)) for k, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, v in whole:
        if q % 100 == 0:
            best = sorted(((-int(v @ w), k) for k, w in whole if k != q and len(w) == len(v)))[:10]
            want |= {(q, r): (k, -s) for r, (s, k) in enumerate(best, 1)}
    assert got == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_counts_of_words_do_not_cross_texts():
    import pyarrow as pa

    from transcripta.llm.wordhash import ALNUM, blocks

    texts = ["ab cd", None, "ef", "", "É1 ß", "cd"]
    ((_, _, w),) = blocks(pa.array(texts), ALNUM)
    assert w.counts().tolist() == [2, 0, 1, 0, 2, 1] and w.hashes[1] == w.hashes[-1]
    assert len(Counter(w.hashes.tolist())) == 5
