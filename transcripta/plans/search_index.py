"""Registered queries of the posting index, each with its SQL: built, grown, thinned out, and read by bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..operators.posting_index import Index
from ..operators.scratch import checkpoint_root
from .catalog import DIGITS, QUERIES, SQL, _documents, _hits, _registered, _search_sql, _shown

__all__ = ["QUERIES", "SQL"]

_PAGE = 50


def _empty(spark: SparkSession) -> Index:
    return Index(spark, f"{checkpoint_root(spark)}/index-{uuid.uuid4().hex}")


def _paged(hits: DataFrame, documents: DataFrame) -> DataFrame:
    return _hits(search.page(_shown(hits).join(documents.drop("text"), "did"), limit=_PAGE))


@_registered(_search_sql(["with", "that"]))
def index_search(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return _paged(_empty(spark).build(docs).ranked(["with", "that"]), docs)


@_registered(_search_sql(["of the", "was"]))
def index_phrase(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return _paged(_empty(spark).build(docs).ranked(["of-the", "was"]), docs)


@_registered(_search_sql(["are"]))
def index_best(spark, sf_dir):
    """The first page by block bounds: equal to the full ranking's."""
    docs = _documents(spark, sf_dir)
    return _paged(_empty(spark).build(docs).best(["are"], _PAGE, digits=DIGITS), docs)


@_registered(_search_sql(["with", "that"]))
def index_grown(spark, sf_dir):
    """An index of three batches, the second replacing half of the first: equal to one built at once."""
    docs = _documents(spark, sf_dir)
    old = docs.where("did % 3 < 2").withColumn("text", F.when(F.col("did") % 2 == 0, F.concat("text", F.lit(" with that with that"))).otherwise(F.col("text")))
    index = _empty(spark).build(old).add(docs.where("did % 3 < 2 and did % 2 = 0")).add(docs.where("did % 3 = 2"))
    return _paged(index.best(["with", "that"], _PAGE, digits=DIGITS), docs)


@_registered(_search_sql(["with"], documents="(select * from documents where doc_id % 5 <> 2)"))
def index_thinned(spark, sf_dir):
    """Under tombstones, counts and lengths are those of the documents that are left."""
    docs = _documents(spark, sf_dir)
    index = _empty(spark).build(docs).without(docs.where("did % 5 = 2").select("did"))
    return _paged(index.best(["with"], _PAGE, digits=DIGITS), docs)


@_registered(_search_sql(["of the"], documents="(select * from documents where doc_id % 5 <> 2)"))
def index_compacted(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    index = _empty(spark).build(docs.where("did % 2 = 0")).add(docs.where("did % 2 = 1")).without(docs.where("did % 5 = 2").select("did"))
    return _paged(index.compacted().ranked(["of-the"]), docs)
