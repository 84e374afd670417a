"""Versions of a policy on shared storage, with one writer at a time winning.

A version is a folder of Parquet tables that is written once and never changed.
What is live and what is draft is said by numbered pointer files: to change
it, a writer that has seen number n renames a file of its own to n + 1, which
the file system lets one of several writers do. Readers take the highest pointer, whose
version is complete by then, so they never see half a version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lifecycle, rulediff

TABLES = {"rules": "selector string, pattern string, action string, category string, priority int", "sources": "source_path string, allowed array<string>", "tools": "tool string, mode string"}


class Conflict(Exception):
    """Another writer was first, or the content isn't what was seen."""


@dataclass(frozen=True)
class Pointer:
    """The state after change ``number``: version numbers of what is live and
    of the draft, the draft's hash, and each version's folder."""

    number: int
    live: int | None
    draft: int | None
    draft_hash: str | None
    folders: dict[int, str]


class Versions:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._at("pointers"))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def pointer(self) -> Pointer:
        """The newest state."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at("pointers"))]
        n = max((int(x) for x in names if x.isdigit()), default=0)
        if not n:
            return Pointer(0, None, None, None, {})
        x = json.loads(self._read(f"pointers/{n}"))
        return Pointer(n, x["live"], x["draft"], x["draft_hash"], {int(k): v for k, v in x["folders"].items()})

    def _read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _advance(self, seen: Pointer, live: int | None, draft: int | None, draft_hash: str | None, folders: dict[int, str]) -> Pointer:
        """Compare and swap: file ``seen.number`` + 1 can be made once only."""
        jvm, draft_file = self.spark._jvm, self._at(f"pointers/.{uuid.uuid4().hex}")
        body = json.dumps({"live": live, "draft": draft, "draft_hash": draft_hash, "folders": folders}) + "\n"
        stream = self.fs.create(draft_file, True)
        stream.write(bytearray(body.encode()))
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:  # a rename that replaces nothing: one of several writers gets the name, with all of the file
            files.rename(draft_file, self._at(f"pointers/{seen.number + 1}"), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(draft_file, False)
            raise Conflict(f"another change came before number {seen.number + 1}") from e
        return Pointer(seen.number + 1, live, draft, draft_hash, folders)

    def read(self, pointer: Pointer, version: int | None) -> dict[str, DataFrame]:
        """A version's tables; of none the empty ones."""
        if version is None:
            return {t: self.spark.createDataFrame([], s) for t, s in TABLES.items()}
        return {t: self.spark.read.schema(s).parquet(f"{self.path}/{pointer.folders[version]}/{t}") for t, s in TABLES.items()}

    def _write(self, content: dict[str, DataFrame]) -> str:
        folder = f"v-{uuid.uuid4().hex}"
        for t, schema in TABLES.items():
            names = [x.split()[0] for x in schema.split(", ")]
            content[t].select(*names).write.parquet(f"{self.path}/{folder}/{t}")
        return folder

    def hash_of(self, content: dict[str, DataFrame]) -> str:
        return lifecycle.content_hash({t: content[t] for t in TABLES}).first()["content_hash"]

    def put_draft(self, content: dict[str, DataFrame], expected: str | None, areas: tuple[str, ...] = tuple(TABLES)) -> Pointer:
        """Makes ``content`` the draft: only its ``areas``, others stay those
        of the draft there is, else of what is live. ``expected``: the hash of
        the draft that the author has seen, None where there was none."""
        seen = self.pointer()
        if seen.draft_hash != expected:
            raise Conflict("the draft isn't the one that was seen")
        base = self.read(seen, seen.draft if seen.draft is not None else seen.live)
        whole = {t: content[t] if t in areas else base[t] for t in TABLES}
        folder = self._write(whole)
        number = seen.draft if seen.draft is not None else max(seen.folders, default=0) + 1
        folders = {**seen.folders, number: folder}
        return self._advance(seen, seen.live, number, self.hash_of(self.read(Pointer(0, None, None, None, folders), number)), folders)

    def drop_draft(self, expected: str) -> Pointer:
        seen = self.pointer()
        if seen.draft is None or seen.draft_hash != expected:
            raise Conflict("the draft isn't the one that was seen")
        return self._advance(seen, seen.live, None, None, {k: v for k, v in seen.folders.items() if k != seen.draft})

    def rollback(self, version: int, expected: str | None) -> Pointer:
        """A copy of an earlier version as the draft."""
        return self.put_draft(self.read(self.pointer(), version), expected)

    def activate(self, expected: str, confirmed: set[str], accepted: set[str], excluded: set[str], manifest: DataFrame, known_tools: DataFrame) -> tuple[list[tuple[str, str]], Pointer]:
        """(problems, state): makes the draft live where nothing forbids it.

        confirmed, accepted, excluded: ids (see lifecycle.compute_diff) of
        weakenings that are agreed to, strengthenings that are taken over, and
        warnings whose rule, source or tool goes. What isn't accepted goes
        back to what it was. Then the difference is computed again, until
        going back and leaving out change nothing more: a weakening that only
        comes up then has to be confirmed too. Problems: CONTENT_CHANGED,
        STALE_CONFIRMATION, WEAKENING_NOT_CONFIRMED, SECRET_ACTIVATION_BLOCKED.
        A policy's changes are few by its bounds, so their ids are collected.
        """
        seen = self.pointer()
        if seen.draft is None or seen.draft_hash != expected:
            return [("CONTENT_CHANGED", expected)], seen
        live, content = self.read(seen, seen.live), self.read(seen, seen.draft)
        diff = lambda c: lifecycle.compute_diff(live, c, manifest, known_tools).collect()
        rows = diff(content)
        ids = lambda rows, class_: {r["id"] for r in rows if r["class"] == class_}
        stale = (confirmed - ids(rows, "weakening")) | (accepted - ids(rows, "strengthening")) | (excluded - ids(rows, "warning"))
        missing = ids(rows, "weakening") - confirmed
        problems = [("STALE_CONFIRMATION", i) for i in sorted(stale)] + [("WEAKENING_NOT_CONFIRMED", i) for i in sorted(missing)]
        while not problems:
            back = [r for r in rows if r["class"] == "strengthening" and r["id"] not in accepted]
            out = [r for r in rows if r["class"] == "warning" and r["id"] in excluded]
            if not back and not out:
                break
            content = self._without(live, content, back, out)
            content = {t: self.spark.read.schema(s).parquet(f"{self.path}/{f}/{t}") for f in [self._write(content)] for t, s in TABLES.items()}
            rows = diff(content)
            problems = [("WEAKENING_NOT_CONFIRMED", i) for i in sorted(ids(rows, "weakening") - confirmed)]
        if not problems:
            problems = sorted({("SECRET_ACTIVATION_BLOCKED", r["subject"]) for r in rows if r["change"] == "SECRET_ACTIVATION_BLOCKED"})
        if problems:
            return problems, seen
        folders = {**seen.folders, seen.draft: self._write(content)}
        return [], self._advance(seen, seen.draft, None, None, folders)

    def _without(self, live: dict[str, DataFrame], content: dict[str, DataFrame], back: list, out: list) -> dict[str, DataFrame]:
        """``content`` with the subjects of ``back`` as they are in ``live``
        and without what the warnings ``out`` are about."""
        names = lambda rows, area: self.spark.createDataFrame([(r["subject"],) for r in rows if r["area"] == area], "__s string").distinct()
        subject = {"rules": F.concat_ws(":", "selector", rulediff.rule_key(F.col("selector"), F.col("pattern"))), "sources": F.col("source_path"), "tools": F.col("tool")}
        area = {"rules": "rules", "sources": "dictionary", "tools": "tools"}
        gone = names([{"subject": r["subject"], "area": "w"} for r in out], "w")
        about = {"rules": F.col("pattern"), "sources": F.col("source_path"), "tools": F.col("tool")}
        new = {}
        for t in TABLES:
            theirs = names(back, area[t])
            if t == "rules":  # a rule that was widened or narrowed goes back under its old key
                pairs = rulediff.rule_changes(live["rules"], content["rules"]).select(F.concat_ws(":", "selector", "subject").alias("__s"), F.concat_ws(":", "selector", rulediff.rule_key(F.col("selector"), F.col("b_pattern"))).alias("__old")).where("__old is not null")
                old = pairs.join(theirs, "__s", "left_semi").select(F.col("__old").alias("__s")).union(theirs).distinct()
            else:
                old = theirs
            kept = content[t].withColumn("__s", subject[t]).join(theirs, "__s", "left_anti").drop("__s")
            was = live[t].withColumn("__s", subject[t]).join(old, "__s", "left_semi").drop("__s")
            both = kept.unionByName(was)
            new[t] = both.withColumn("__s", about[t]).join(gone, "__s", "left_anti").drop("__s")
        return new
