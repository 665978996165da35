"""An index whose units are added, replaced and deleted: segments, tombstones, merges by tiers.

A write is one new segment. Rows of older segments that it replaces, or that a deletion names, stay where they
are and are named in a table of tombstones (segment, id); readers leave them out, of postings, lengths, document
frequencies and the corpus's size alike. Segments of about one size are merged once there are enough of
them, and rows that are dead don't go along. A manifest names segments and tombstones, so a write that breaks off
leaves nothing that readers see.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.index import LENGTHS, POSTINGS, Index, build_index
from lectern.sources.manifest import Manifest
from lectern.sources.scratch import scratch

#: Segments of a tier that are merged into one.
FAN = 8
#: Tombstones are broadcast up to this number (some 50 MB), else joined by shuffle.
BROADCAST_DEAD = 500_000
DEAD = "segment string, id long"


class LivingIndex:
    """The index at ``path`` over text ``columns`` of units (id and columns)."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], stemmed: bool = True, fan: int = FAN):
        self.spark, self.path, self.columns, self.stemmed, self.fan = spark, path.rstrip("/"), columns, stemmed, fan
        self.manifest = Manifest(spark, self.path)

    # ---- reading

    def _state(self) -> tuple[int, dict]:
        version, state = self.manifest.read()
        return version, {"segments": {}, "tombstones": [], "token": None, **state}

    def _read(self, kind: str, schema: str, segments: list[str]) -> DataFrame:
        paths = [f"{self.path}/{kind}/segment={s}" for s in segments]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        return self.spark.read.schema(f"{schema}, segment string").option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def _dead(self, state: dict) -> DataFrame:
        paths = [f"{self.path}/tombstones/{t}" for t in state["tombstones"]]
        return self.spark.read.schema(DEAD).parquet(*paths) if paths else self.spark.createDataFrame([], DEAD)

    def _live(self, kind: str, schema: str, state: dict, segments: list[str]) -> DataFrame:
        rows, n_dead = self._read(kind, schema, segments), sum(state["segments"][s]["dead"] for s in segments)
        if not n_dead:
            return rows
        dead = self._dead(state).distinct()
        return rows.join(F.broadcast(dead) if sum(s["dead"] for s in state["segments"].values()) <= BROADCAST_DEAD else dead, ["segment", "id"], "left_anti")

    def index(self) -> Index:
        """The index as it stands. Its size comes from the manifest: no scan, however many rows have died."""
        _, state = self._state()
        segments = state["segments"]
        n = sum(s["rows"] - s["dead"] for s in segments.values())
        tokens = sum(s["tokens"] - s["dead_tokens"] for s in segments.values())
        postings = self._live("postings", POSTINGS, state, list(segments)).drop("segment")
        lengths = self._live("lengths", LENGTHS, state, list(segments)).drop("segment")
        return Index(postings, lengths, self.columns, self.stemmed, known_size=(n, tokens / n if n else 0.0))

    # ---- writing

    def write(self, units: DataFrame, token: int | None = None) -> None:
        """Adds units; those whose id is there already replace it. Ids are unique within a write (an error if not).

        ``token``: a number that grows from write to write, as that of a micro-batch; a write whose token is not
        beyond the last one has been done before and does nothing.
        """
        version, state = self._state()
        if token is not None and state["token"] is not None and token <= state["token"]:
            return
        if units.groupBy("id").count().filter("count > 1").limit(1).count():
            raise ValueError("ids repeat within a write")
        name = uuid.uuid4().hex
        built = build_index(units, self.columns, self.stemmed)
        found = self._store(name, built.postings, built.lengths)
        self._bury(state, self.spark.read.schema(LENGTHS).parquet(f"{self.path}/lengths/segment={name}").select("id"))
        state["segments"][name] = found
        if token is not None:
            state["token"] = token
        self._merge_due(state)
        self.manifest.commit(version, state)

    def delete(self, ids: DataFrame) -> None:
        """Deletes units by ``id``; ids that aren't there are ignored."""
        version, state = self._state()
        self._bury(state, ids.select("id"))
        self._merge_due(state)
        self.manifest.commit(version, state)

    def _store(self, name: str, postings: DataFrame, lengths: DataFrame) -> dict:
        """Writes a segment, in order of term, and gives its figures."""
        postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.parquet(f"{self.path}/postings/segment={name}")
        lengths.write.parquet(f"{self.path}/lengths/segment={name}")
        rows, tokens = self.spark.read.schema(LENGTHS).parquet(f"{self.path}/lengths/segment={name}").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"rows": rows, "tokens": tokens, "dead": 0, "dead_tokens": 0}

    def _bury(self, state: dict, ids: DataFrame) -> None:
        """Tombstones for what the segments hold alive of some ids."""
        segments = list(state["segments"])
        if not segments:
            return
        gone = scratch(self._live("lengths", LENGTHS, state, segments).join(ids.distinct(), "id", "left_semi").select("segment", "id", "dl"), "gone")
        counts = gone.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens")).collect()  # a row for each segment
        if counts:
            name = uuid.uuid4().hex
            gone.select("segment", "id").write.parquet(f"{self.path}/tombstones/{name}")
            state["tombstones"].append(name)
        for r in counts:
            state["segments"][r.segment]["dead"] += r.n
            state["segments"][r.segment]["dead_tokens"] += r.tokens

    def _tier(self, segment: dict) -> int:
        return int(math.log(max(1, segment["rows"] - segment["dead"]), self.fan))

    def _merge_due(self, state: dict) -> None:
        """Merges every tier of ``fan`` segments or more, and rewrites segments of which more than half is dead."""
        while True:
            tiers: dict[int, list[str]] = {}
            for name, s in state["segments"].items():
                tiers.setdefault(self._tier(s), []).append(name)
            due = next((names for names in tiers.values() if len(names) >= self.fan), None)
            due = due or [n for n, s in state["segments"].items() if 2 * s["dead"] > s["rows"]]
            if not due:
                return
            self._merge(state, due)

    def _merge(self, state: dict, names: list[str]) -> None:
        """One segment of what lives in some; tombstones of theirs go."""
        merged = uuid.uuid4().hex
        found = self._store(merged, self._live("postings", POSTINGS, state, names).drop("segment"), self._live("lengths", LENGTHS, state, names).drop("segment"))
        left = {n: s for n, s in state["segments"].items() if n not in names}
        dead = self._dead(state)
        state["segments"] = left | ({merged: found} if found["rows"] else {})
        state["tombstones"] = []
        if any(s["dead"] for s in left.values()):
            name = uuid.uuid4().hex
            dead.filter(F.col("segment").isin(list(left))).write.parquet(f"{self.path}/tombstones/{name}")
            state["tombstones"] = [name]

    def merge(self) -> None:
        """Merges all segments into one without dead rows."""
        version, state = self._state()
        if len(state["segments"]) > 1 or any(s["dead"] for s in state["segments"].values()):
            self._merge(state, list(state["segments"]))
            self.manifest.commit(version, state)

    def vacuum(self) -> None:
        """Deletes what the last version doesn't name: merged segments and leftovers of writes that broke off. No reader or writer may be at work."""
        _, state = self._state()
        named = {f"segment={s}" for s in state["segments"]} | set(state["tombstones"])
        for kind in ("postings", "lengths", "tombstones"):
            for folder in self.manifest.folders(f"{self.path}/{kind}"):
                if folder not in named:
                    self.manifest.drop(f"{self.path}/{kind}/{folder}")
