"""A versioned store of the canonical tables, their histogram and their profiles.

Sales come in **slices** (a register file's year, or the year of sale).  A version is a manifest: a small JSON file that
names, for every slice, the load that wrote it.  ``sync`` loads only slices that changed, writes their
sales and their histogram beside the older loads, recomputes the profiles of the years these touch from the
merged histograms, and then publishes the next manifest.  Readers see one version throughout.

* Nothing changed: nothing is read but file names and sizes, and nothing is written, in any session.
* A failed or lost run leaves files that no manifest names; the previous version stays the latest.
* Two writers: publishing fails where the version exists already.
* Retention: the latest ``keep`` versions and the loads that they name stay, all others are removed.

The store lies in one folder of any file system that Hadoop reads.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config
from ..operators import cube
from ..plans import profiles as P
from ..session import materialize
from . import schemas
from .synthetic import TX_COLUMNS

#: Profiles that belong to one year; ``all`` spans the years.
YEARLY = tuple(n for n in P.NAMES if n != "all")


class Files:
    """What the store needs of a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        sc = spark.sparkContext
        self.jvm, self.root = sc._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(sc._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file as a whole; fails if it is there."""
        draft = self.path(f"{name}.{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.path(name)) or not self.fs.rename(draft, self.path(name)):
            self.fs.delete(draft, False)
            raise RuntimeError(f"{self.root}/{name} was published by another writer")

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def fingerprint(spark: SparkSession, path: str) -> str | None:
    """Names, sizes and modification times of a file or a folder's files; None if it isn't there."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        st = files.next()
        found.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:24]


class Store:
    def __init__(self, spark: SparkSession, root: str, cfg: Config, keep: int = 2):
        self.spark, self.root, self.cfg, self.keep = spark, root.rstrip("/"), cfg, keep
        self.files = Files(spark, root)

    # -- versions -------------------------------------------------------------
    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version (default: the latest), or None in an empty store."""
        have = self.versions()
        return json.loads(self.files.read(f"versions/{version or have[-1]:08d}.json")) if have else None

    def config_key(self) -> str:
        return hashlib.sha256(repr(self.cfg).encode()).hexdigest()[:24]

    # -- readers --------------------------------------------------------------
    def _read(self, kind: str, loads: Mapping[str, str], schema=None) -> DataFrame:
        """A table's loads; ``loads`` names a partition folder each."""
        reader = self.spark.read.option("basePath", f"{self.root}/{kind}")
        return (reader.schema(schema) if schema else reader).parquet(*[f"{self.root}/{kind}/{at}/load={load}" for at, load in sorted(loads.items())])

    def transactions(self, m: dict, keyed: bool = False) -> DataFrame:
        loads = {f"slice={s}": v["load"] for s, v in m["slices"].items()}
        return self._read("transactions", loads).drop("slice", "load") if keyed else self._read("transactions", loads, schemas.TRANSACTIONS).select(*TX_COLUMNS)

    def histogram(self, m: dict) -> DataFrame:
        """The sales' histogram by cell, merged over the slices where they share a year."""
        found = self._read("histogram", {f"slice={s}": v["load"] for s, v in m["slices"].items()}).drop("slice", "load")
        years = [y for v in m["slices"].values() for y in v["years"]]
        return found if len(years) == len(set(years)) else materialize(cube.rolled(found, P.DIMS))

    def profiles(self, m: dict) -> DataFrame:
        loads = {f"of={y}": load for y, load in m["profiles"].items()}
        return self._read("profiles", loads).drop("of", "load")

    def table(self, m: dict, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/load={m['tables'][name]}")

    # -- writer ---------------------------------------------------------------
    def sync(self, sources: Mapping[str, str] | None, load: Callable[[list[str] | None], DataFrame], tables: Callable[["Store", dict], Iterable[tuple[str, DataFrame]]] | None = None,
             inputs: str = "", old: dict | None = None) -> dict:
        """Bring the store to ``sources`` (slice -> fingerprint) and return its manifest.

        ``load`` gives the clean sales of some slices with a column ``slice``; ``tables`` the further tables to
        store, given the new version; ``inputs`` is the fingerprint of what else they depend on.
        ``sources`` None: everything is loaded, and the slices are those found.  ``old`` is the version to go on from (default: the latest).
        """
        old = old or self.manifest()
        same = old is not None and old["config"] == self.config_key()
        before = old["slices"] if same else {}
        changed = None if sources is None else sorted(s for s, f in sources.items() if s not in before or before[s]["source"] != f)
        gone = sorted(s for s in before if sources is None or s not in sources)
        if same and changed == [] and not gone and old["inputs"] == inputs:
            return old
        this = "v" + uuid.uuid4().hex[:12]
        m = {"version": (old["version"] if old else 0) + 1, "load": this, "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "config": self.config_key(), "inputs": inputs,
             "slices": {s: v for s, v in before.items() if sources and s in sources and s not in changed}, "profiles": dict(old["profiles"]) if same else {}, "tables": {}}
        touched = {y for s in (*(changed or ()), *gone) if s in before for y in before[s]["years"]}
        if changed != []:
            self._write_sales(load(changed), this)
            counts = self.spark.read.parquet(f"{self.root}/histogram").where((F.col("load") == this)).groupBy("slice", "year").agg(F.sum("n").alias("n")).collect()  # slices x calendar years
            rows: dict[str, dict[int, int]] = {}
            for r in counts:
                rows.setdefault(str(r["slice"]), {})[r["year"]] = r["n"]
            for s in rows if changed is None else changed:
                if s in rows:  # a slice without clean sales has no files
                    m["slices"][s] = {"load": this, "source": sources[s] if sources else "", "years": sorted(rows[s]), "rows": sum(rows[s].values())}
                    touched |= set(rows[s])
        if not m["slices"]:
            raise ValueError("no slice holds clean sales")
        if changed != [] or gone or not same:
            self._write_profiles(m, sorted(touched), this)
        for name, df in tables(self, m) if tables else ():  # a later table may read an earlier one
            df.write.parquet(f"{self.root}/{name}/load={this}")
            m["tables"][name] = this
        self.files.publish(f"versions/{m['version']:08d}.json", json.dumps(m, indent=1, sort_keys=True))
        self._retain()
        return m

    def _write_sales(self, sales: DataFrame, this: str) -> None:
        """Sales and histogram of this load's slices: one read of the input, one of what was written."""
        sales = sales.withColumn("price_eur", F.col("price_eur").cast("decimal(12,2)")).withColumn("load", F.lit(this))
        (sales.hint("rebalance", "slice", "year").sortWithinPartitions("slice", "year", "county", "date_of_sale")
              .write.mode("append").option("maxRecordsPerFile", 5_000_000).partitionBy("slice", "load", "year").parquet(f"{self.root}/transactions"))
        written = self.spark.read.parquet(f"{self.root}/transactions").where(F.col("load") == this)
        cells = P.cells(written.withColumn("slice", F.col("slice").cast("string")), self.cfg, "slice")
        (cube.histogram(cells, ("slice", *P.DIMS)).withColumn("load", F.lit(this)).hint("rebalance", "slice")
             .write.mode("append").partitionBy("slice", "load").parquet(f"{self.root}/histogram"))

    def _write_profiles(self, m: dict, years: list[int], this: str) -> None:
        """Profiles of the touched years and of all, from the merged histograms and one read of the sales behind them."""
        have = {y for v in m["slices"].values() for y in v["years"]}
        mine = [y for y in years if y in have]
        tx, hist = self.transactions(m), self.histogram(m)
        if set(mine) != have:
            # the other years' rows only count for what spans the years
            of_years = F.col("year").isin(*mine)
            found = P.profiles(tx, self.cfg, hist, only=("all",))
            if mine:
                found = found.unionByName(P.profiles(tx.where(of_years), self.cfg, hist.where(of_years), only=YEARLY))
        else:
            found = P.profiles(tx, self.cfg, hist)
        of = F.when(F.col("profile") == "all", F.lit("all")).otherwise(F.col("year").cast("string"))
        (found.withColumn("of", of).withColumn("load", F.lit(this)).repartition("of").write.mode("append").partitionBy("of", "load").parquet(f"{self.root}/profiles"))
        m["profiles"] = {y: load for y, load in m["profiles"].items() if y != "all" and int(y) in have}
        wrote = {r["of"] for r in self.spark.read.parquet(f"{self.root}/profiles").where(F.col("load") == this).select(F.col("of").cast("string").alias("of")).distinct().collect()}  # calendar years
        m["profiles"] |= {y: this for y in wrote}

    def _retain(self) -> None:
        """Remove versions beyond the latest ``keep`` and loads that no version left names."""
        have = self.versions()
        for v in have[: -self.keep]:
            self.files.remove(f"versions/{v:08d}.json")
        kept = [self.manifest(v) for v in have[-self.keep :]]
        named = {v["load"] for m in kept for v in m["slices"].values()} | {load for m in kept for load in (*m["profiles"].values(), *m["tables"].values())}
        for kind in self.files.names(""):
            if kind == "versions":
                continue
            for at in self.files.names(kind):
                if at.startswith("load=") and at[5:] not in named:
                    self.files.remove(f"{kind}/{at}")
                elif "=" in at and not at.startswith("load="):
                    used = self._used(kept, kind, at)
                    for load in self.files.names(f"{kind}/{at}"):
                        if load.startswith("load=") and load[5:] not in used:
                            self.files.remove(f"{kind}/{at}/{load}")

    @staticmethod
    def _used(kept: Iterable[dict], kind: str, at: str) -> set[str]:
        key = at.split("=", 1)[1]
        return {m["profiles"].get(key) for m in kept} if kind == "profiles" else {m["slices"].get(key, {}).get("load") for m in kept}


def year_sources(sales: DataFrame) -> dict[str, str]:
    """Slices by year of sale with a fingerprint of their rows, for inputs that aren't kept by year: one aggregation."""
    rows = sales.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[c for c in sales.columns]).cast("decimal(38,0)")).alias("h"))
    return {str(r["year"]): f"{r['n']}-{r['h']}" for r in rows.collect()}  # a row per calendar year
