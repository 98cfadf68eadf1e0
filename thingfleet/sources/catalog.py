"""The directory on disk, lookups and listings.

A store is a folder of data and a log of versions. A version's data are complete before its number is
claimed in the log, so a job that dies half-way leaves nothing visible.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..operators.triples import assemble
from ..schema import QUAD_COLS, QUADS
from .graphs import write_quads
from .versions import VersionLog

DEFAULT_LIMIT = 20


class Conflict(Exception):
    """A version committed in between changes documents or graphs that this commit changes as well."""


class Store:
    """Versions of ``things`` (id, body) and ``quads`` below ``path``.

    A version is whole, or holds the documents and graphs that changed since the one before; readers lay the
    changes over the last whole version. Several writers may commit at once.
    """

    _KEYS = {"things": ("id", "id string, body string"), "quads": ("g", QUADS)}

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        self._log = VersionLog(spark, self._path)

    def current(self) -> int | None:
        return self._log.last()

    def _write(self, things: DataFrame, quads: DataFrame) -> str:
        home = f"data-{uuid.uuid4().hex}"
        things.select("id", "body").repartition("id").sortWithinPartitions("id").write.parquet(
            f"{self._path}/{home}/things"
        )
        write_quads(quads, f"{self._path}/{home}/quads")
        return home

    def commit(self, things: DataFrame, quads: DataFrame, read: int | None = None) -> int:
        """Write everything as a new version, then make it visible.

        With ``read``, the version that the new one was made from, a version committed since is a
        :class:`Conflict`; without it, the new version follows whatever is there.
        """
        home = self._write(things, quads)
        version = ((self.current() or 0) if read is None else read) + 1
        while not self._log.claim(version, True, home):
            if read is not None:
                raise Conflict(f"version {version} was committed in between")
            version += 1
        return version

    def commit_changes(
        self,
        things: DataFrame,
        quads: DataFrame,
        deleted: DataFrame | None = None,
        emptied: DataFrame | None = None,
        read: int | None = None,
    ) -> int:
        """Write only new and changed documents (``id, body``, one row each) and whole changed graphs.

        ``deleted`` (``id``) and ``emptied`` (``g``) name documents and graphs that are gone; a graph in
        ``quads`` loses what it had. ``read`` is the version that the changes were made from, the current one by
        default. When others have committed since, the changes follow theirs if no document and no graph is in
        both, without being written again; else this is a :class:`Conflict`.
        """
        read = (self.current() or 0) if read is None else read
        home = self._write(things, quads)
        for part, rows, gone in (("things", things, deleted), ("quads", quads, emptied)):
            key = self._KEYS[part][0]
            keys = rows.select(key) if gone is None else rows.select(key).unionByName(gone.select(key))
            keys.distinct().write.parquet(f"{self._path}/{home}/keys-{part}")
        version = read + 1
        while not self._log.claim(version, False, home):
            other = self._log.entry(version)
            if other.whole or self._overlap(home, other.folder):
                raise Conflict(f"version {version} was committed in between")
            version += 1
        return version

    def _keys(self, home: str, part: str) -> DataFrame:
        return self._spark.read.schema(f"{self._KEYS[part][0]} string").parquet(f"{self._path}/{home}/keys-{part}")

    def _overlap(self, mine: str, other: str) -> bool:
        return any(
            not self._keys(mine, part).join(self._keys(other, part), key, "left_semi").isEmpty()
            for part, (key, _) in self._KEYS.items()
        )

    def compact(self) -> int:
        """Write the current version as a whole one, so that readers have no changes to lay over it."""
        read = self.current()
        return self.commit(self.things(read), self.quads(read), read)

    def _read(self, part: str, version: int | None) -> DataFrame:
        version = self.current() if version is None else version
        if version is None:
            raise ValueError("the store is empty")
        key, schema = self._KEYS[part]
        chain = self._log.chain(version)
        read = lambda v: self._spark.read.schema(schema).parquet(f"{self._path}/{v.folder}/{part}")
        if len(chain) == 1:
            return read(chain[0])
        # a row counts unless a later version of the chain has its key
        mark = lambda df, v: df.withColumn("__v", F.lit(v.number))
        rows = reduce(DataFrame.unionByName, [mark(read(v), v) for v in chain])
        changes = [mark(self._keys(v.folder, part), v) for v in chain if not v.whole]
        last = reduce(DataFrame.unionByName, changes).groupBy(key).agg(F.max("__v").alias("__last"))
        kept = rows.join(last, key, "left").where("__last IS NULL OR __v = __last")
        return kept.drop("__v", "__last")

    def things(self, version: int | None = None) -> DataFrame:
        return self._read("things", version).select("id", "body")

    def quads(self, version: int | None = None) -> DataFrame:
        return self._read("quads", version).select(*QUAD_COLS)


def graph(quads: DataFrame, g: str) -> DataFrame:
    return quads.where(F.col("g") == g)


def rebuild_things(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents from quads, upgraded; and the graphs that gave none."""
    docs, refused = assemble(quads)
    upgraded = D.upgrade(D.fields(F.parse_json("body")))
    return docs.select("id", F.to_json(upgraded).alias("body")), refused


def refresh_things(things: DataFrame, quads: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuild only the documents of ``changed`` graphs (columns ``g`` and ``id``).

    A changed document disappears only when its graph is empty. A graph that gives no document keeps
    the old one; the second table lists such graphs with the reason.
    """
    part = quads.join(changed.select("g").distinct(), "g", "left_semi")
    rebuilt, refused = rebuild_things(part)
    kept_back = changed.join(refused.select("g"), "g", "left_semi").select("id")
    replaced = changed.select("id").distinct().join(kept_back, "id", "left_anti")
    return things.join(replaced, "id", "left_anti").unionByName(rebuilt), refused


# ---------------------------------------------------------------- lookups and listings


def lookup(things: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with the given ids."""
    return things.join(ids.select("id").distinct(), "id", "left_semi")


def retrieve(things: DataFrame, id_: str) -> DataFrame:
    return things.where(F.col("id") == id_)


def exists(things: DataFrame, id_: str) -> bool:
    return not retrieve(things, id_).limit(1).isEmpty()


def exists_flags(ids: DataFrame, things: DataFrame) -> DataFrame:
    """``id, found`` for each given id."""
    here = things.select("id", F.lit(True).alias("found")).dropDuplicates(["id"])
    return ids.select("id").join(here, "id", "left").select(
        "id", F.coalesce("found", F.lit(False)).alias("found")
    )


def list_things(
    things: DataFrame,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    sort_by: str = "id",
    sort_order: str = "asc",
) -> DataFrame:
    """One page of documents, ordered, ties broken by id.

    Limit, offset and order are applied, not only accepted.
    """
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    if sort_order not in ("asc", "desc"):
        raise ValueError("sort_order is asc or desc")
    key = F.col(sort_by).desc() if sort_order == "desc" else F.col(sort_by).asc()
    rows = things.orderBy(key, F.col("id").asc())
    return rows.offset(offset).limit(limit) if offset else rows.limit(limit)


def page_meta(things: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """``total, offset, limit, next_offset``; there is a next page while documents remain."""
    following = F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit).cast("bigint"))
    return things.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(offset).cast("bigint").alias("offset"),
        F.lit(limit).cast("bigint").alias("limit"),
        following.alias("next_offset"),
    )


def search(things: DataFrame, path: D.Path) -> DataFrame:
    """Documents in which ``path`` reaches something. ``things`` has ``body`` text or ``doc``."""
    doc = F.col("doc") if "doc" in things.columns else F.try_parse_json("body")
    bound = D.nesting_depth(F.col("body")) if "body" in things.columns else None
    return things.where(path.found(doc, bound))


def search_all(things: DataFrame, *paths: D.Path) -> DataFrame:
    """Documents in which every path reaches something: tests inside the row, no join."""
    for path in paths:
        things = search(things, path)
    return things


def variant_search(things: DataFrame, path: str) -> DataFrame:
    """Documents where Spark's own VARIANT path ``$...`` finds a value."""
    if not path.startswith("$"):
        raise ValueError("a path starts with $")
    return things.where(F.try_variant_get("doc", path, "variant").isNotNull())
