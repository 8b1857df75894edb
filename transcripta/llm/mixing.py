"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, language, topic).  Raking scales
the cells' token weights to the target marginals of one dimension after the
other, for ``rounds`` rounds; a cell's weight over its tokens is its documents'
calibration, and a document is sampled with probability
``min(1, share * calibration)``, by a hash of its id, so any run samples alike.
A cell whose ``share * calibration`` is above 1 is cut off there, and the targets
are missed; without a share, it is 1 over the largest calibration, the most at
which the sample's expected shares are those that raking reached.

A target is a mapping from value to share, or a power: ``0.5`` asks for shares in
proportion to the square roots of those found, which lifts rare values.  Values
that a mapping lacks get no weight.

The topic of a text is a bucket of its longest word (the first in order among
the longest), unless a topic column is named.  A null source, language or topic
is the value ""; null and empty texts have no tokens, topic 0 and take part with
their cell's calibration, which is 1 where a cell has no tokens.  Rows with a
null id are sampled by the hash of "".  Repeated rows are sampled together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settled

TOPICS = 8
ROUNDS = 20
#: Up to so many cells (a few MB) are raked on the driver and broadcast; more are
#: raked and joined by their keys.
MOST_CELLS = 50_000
DIMENSIONS = ("source", "lang", "topic")
SEED = "mix-1"

Target = float | dict[str, float]


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def topic_of(words: Column) -> Column:
    """A bucket of the longest word; 0 without words."""
    first = F.array_min(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("word"))))["word"]
    return F.coalesce(F.conv(F.substring(F.md5(first), 1, 4), 16, 10).cast("int") % TOPICS, F.lit(0)).cast("string")


def uniform(id_col: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def _targeted(cells: DataFrame, targets: dict[str, Target]) -> DataFrame:
    """``cells`` with the target shares t_source, t_lang and t_topic."""
    for d in DIMENSIONS:
        if isinstance(targets[d], dict):
            total = float(sum(targets[d].values()))
            pairs = [F.lit(x) for item in sorted(targets[d].items()) for x in (item[0], item[1] / total)]
            cells = cells.withColumn(f"t_{d}", F.coalesce(F.element_at(F.create_map(*pairs), F.col(d)), F.lit(0.0)))
        else:
            found = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(targets[d]))).alias("found"))
            total = float(found.agg(F.sum("found")).first()[0] or 1.0)
            cells = cells.join(found.select(d, (F.col("found") / F.lit(total)).alias(f"t_{d}")), d)
    return cells


def _raked_here(table: pd.DataFrame, rounds: int) -> pd.DataFrame:
    """Raking of a table of bounded size."""
    weight = table["tokens"].to_numpy(np.float64)
    whole = weight.sum()
    codes = {d: np.unique(table[d], return_inverse=True)[1] for d in DIMENSIONS}
    for _ in range(rounds):
        for d in DIMENSIONS:
            own = np.bincount(codes[d], weight)[codes[d]] if len(weight) else weight
            weight = np.divide(weight * table[f"t_{d}"].to_numpy() * whole, own, out=np.zeros_like(weight), where=own > 0)
    return table[[*DIMENSIONS, "tokens"]].assign(weight=weight)


def _raked_apart(cells: DataFrame, rounds: int) -> DataFrame:
    """Raking of a table of any size; each round is settled in the shared folder."""
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for d in DIMENSIONS:
            own = cells.groupBy(d).agg(F.sum("weight").alias("own"))
            scaled = F.when(F.col("own") > 0, F.col("weight") * F.col(f"t_{d}") * F.lit(whole) / F.col("own")).otherwise(0.0)
            cells = cells.join(own, d).withColumn("weight", scaled).drop("own")
        cells = settled(cells, "cells")
    return cells.select(*DIMENSIONS, "tokens", "weight")


def raked(cells: DataFrame, targets: dict[str, Target], rounds: int = ROUNDS, most_here: int = MOST_CELLS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight`` raked to the targets.

    Up to ``most_here`` cells are raked on the driver, more by joins: the results
    are the same.
    """
    cells = settled(_targeted(settled(cells, "cells"), targets), "cells")
    if cells.count() > most_here:
        return _raked_apart(cells, rounds)
    table = _raked_here(cells.toPandas().sort_values(list(DIMENSIONS)), rounds)
    return cells.sparkSession.createDataFrame(table, "source string, lang string, topic string, tokens long, weight double")


def mixed(docs: DataFrame, targets: dict[str, Target] | None = None, share: float | None = 0.5, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Each row's source, lang, topic, n_tokens, calibration, probability and sampled, then ``keep``."""
    targets = targets or {d: 0.5 for d in DIMENSIONS}
    keep = [] if keep is None else keep
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), docs[lang_col].alias("lang"), tokens_of(docs[text_col]).alias("words"), *([docs[topic_col].cast("string").alias("given")] if topic_col else []), *(docs[c].alias(f"kept_{k}") for k, c in enumerate(keep)))
    topic = F.coalesce("given", F.lit("")) if topic_col else topic_of(F.col("words"))
    rows = rows.select("id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic.alias("topic"), F.size("words").cast("long").alias("n_tokens"), *(f"kept_{k}" for k in range(len(keep))))
    if not keep:
        # what is read twice is narrow: one scan of the texts is enough
        rows = settled(rows, "mixing")
    cells = raked(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), targets, rounds)
    factor = cells.select(*DIMENSIONS, F.round(F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0), 6).alias("calibration"))
    if share is None:
        share = 1 / max(factor.where("calibration > 0").agg(F.max("calibration")).first()[0] or 1.0, 1.0)
    if cells.count() <= MOST_CELLS:
        factor = F.broadcast(factor)
    out = rows.join(factor, list(DIMENSIONS))
    probability = F.least(F.lit(1.0), F.col("calibration") * F.lit(float(share)))
    out = out.withColumn("probability", probability).withColumn("sampled", uniform(F.col("id")) < F.col("probability"))
    return out.select(F.col("id").alias(id_col), *DIMENSIONS, "n_tokens", "calibration", "probability", "sampled", *(F.col(f"kept_{k}").alias(f"kept_{k}") for k in range(len(keep))))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs``, with its columns."""
    columns = docs.columns
    out = mixed(docs, keep=columns, **options).where("sampled")
    return out.select(*(F.col(f"kept_{k}").alias(c) for k, c in enumerate(columns)))


def oracle_sql(share: float = 0.5, rounds: int = ROUNDS) -> str:
    """The same over ``documents`` with all targets 0.5."""
    steps = []
    last = "start"
    for k in range(rounds):
        for d in DIMENSIONS:
            name = f"r{k}_{d}"
            steps.append(f"{name} as materialized (select source, lang, topic, tokens, t_source, t_lang, t_topic, whole, case when sum(weight) over (partition by {d}) > 0 then weight * t_{d} * whole / sum(weight) over (partition by {d}) else 0 end weight from {last})")
            last = name
    powers = ", ".join(f"{d}_p as (select {d}, pow(sum(tokens)::double, 0.5) p from cells group by 1)" for d in DIMENSIONS)
    shares = ", ".join(f"{d}_p.p / (select sum(p) from {d}_p) t_{d}" for d in DIMENSIONS)
    joins = " ".join(f"join {d}_p using ({d})" for d in DIMENSIONS)
    return f"""
with words as (select doc_id, coalesce(source, '') source, coalesce(lang, '') lang, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
longest as (select *, list_max(list_transform(w, lambda x: length(x))) m from words),
rows as (select doc_id, source, lang, coalesce(('0x' || substr(md5(list_min(list_filter(w, lambda x: length(x) = m))), 1, 4))::int % {TOPICS}, 0)::varchar topic, len(w) n_tokens from longest),
cells as (select source, lang, topic, sum(n_tokens)::bigint tokens from rows group by all),
{powers},
start as (select source, lang, topic, tokens, {shares}, (select sum(tokens)::double from cells) whole, tokens::double weight from cells {joins}),
{", ".join(steps)},
factor as (select source, lang, topic, round(case when tokens > 0 then weight / tokens else 1 end, 6) calibration from {last}),
calibrated as (select rows.*, calibration, least(1.0::double, calibration * {share}::double) probability from rows join factor using (source, lang, topic))
select doc_id, source, lang, topic, n_tokens, calibration, probability,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / {1 << 52}.0::double < probability sampled
from calibrated"""
