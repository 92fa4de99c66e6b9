"""Where jobs read their inputs from.

``DerivedSources`` derives the canonical tables from the driver's tables on
use.  ``StoredSources`` reads one version of a ``store.Store``: the sales by
slice and year, their profiles, the two (place, year) dimension tables and the
scores, in the types of ``schemas``.  ``materialize`` brings such a store up to date;
``stored_for`` does that once per session for the driver-contract queries, keyed by
the inputs' modification times and sizes.  ``RegisterSources`` reads a real
deployment: the clean table plus the stored dimension CSVs.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config, DEFAULT
from ..plans import profiles as P
from ..session import materialize as checkpointed
from . import schemas, synthetic as S
from .register import read_dimension_csv, read_scores_csv, read_transactions
from .store import Store, fingerprint, year_sources


class DerivedSources:
    def __init__(self, spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT):
        self.spark, self.sf_dir, self.cfg = spark, sf_dir, cfg
        self._found: dict[tuple[str, ...], DataFrame] = {}
        self._hist: DataFrame | None = None

    def tx(self) -> DataFrame:
        return S.transactions(self.spark, self.sf_dir, self.cfg)

    def ms(self) -> DataFrame:
        return self.tx().where(~F.col("not_full_market"))

    def aff(self) -> DataFrame:
        return S.affordability_from(self.profile(), S.places(self.spark, self.sf_dir), self.customer())

    def sd(self) -> DataFrame:
        return S.supply_demand(self.spark, self.sf_dir, self.cfg)

    def scores(self) -> DataFrame:
        from ..plans.invest import investment_scores
        return investment_scores(self.aff(), self.sd(), self.cfg)

    def customer(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/customer.parquet")

    def histogram(self) -> DataFrame:
        """The sales' histogram by cell, made once per sources object."""
        if self._hist is None:
            self._hist = checkpointed(P.histogram(self.tx(), self.cfg))
        return self._hist

    def profiles(self, *only: str) -> DataFrame:
        """Rows of some profiles, made once per sources object."""
        if only not in self._found:
            self._found[only] = checkpointed(P.profiles(self.tx(), self.cfg, self.histogram(), only))
        return self._found[only]

    def profile(self) -> DataFrame:
        return P.place_year(self.profiles("place_year"))

    def month_profile(self) -> DataFrame:
        return P.place_month(self.profiles("place_month"))

    def type_profile(self) -> DataFrame:
        return P.place_type(self.profiles("place_type"))

    def segment_profile(self) -> DataFrame:
        return P.place_segment(self.profiles("place_segment"))

    def side(self) -> DataFrame:
        return self.profiles("focus", "region", "month", "vat", "postcode", "zone")

    def load_profile(self) -> DataFrame:
        return P.load_profile(self.profiles("all"), self.histogram())

    def at_rest(self, name: str) -> DataFrame:
        """One of the four tables in its stored types."""
        df = {"transactions": self.tx, "affordability": self.aff, "supply_demand": self.sd, "investment_scores": self.scores}[name]()
        return schemas.at_rest(df, schemas.TABLES[name])


class StoredSources(DerivedSources):
    """One version of a store."""

    def __init__(self, store: Store, sf_dir: str = "", manifest: dict | None = None):
        super().__init__(store.spark, sf_dir, store.cfg)
        self.store, self.manifest = store, manifest or store.manifest()

    def tx(self) -> DataFrame:
        return self.store.transactions(self.manifest)

    def at_rest(self, name: str) -> DataFrame:
        return self.tx() if name == "transactions" else self.store.table(self.manifest, name)

    def aff(self) -> DataFrame:
        return schemas.for_jobs(self.at_rest("affordability"))

    def sd(self) -> DataFrame:
        return schemas.for_jobs(self.at_rest("supply_demand"))

    def scores(self) -> DataFrame:
        return schemas.for_jobs(self.at_rest("investment_scores"))

    def histogram(self) -> DataFrame:
        return self.store.histogram(self.manifest)

    def profiles(self, *only: str) -> DataFrame:
        return self.store.profiles(self.manifest).where(F.col("profile").isin(*only))


def materialize(spark: SparkSession, sf_dir: str, root: str, cfg: Config = DEFAULT, keep: int = 2) -> StoredSources:
    """Bring the store at ``root`` up to the driver's tables; return sources reading its latest version.

    The one large join (orders -> customers) runs once.  Unchanged input files: nothing is read or written.
    Otherwise the years of sale whose rows changed are loaded again, the others stay.
    """
    store, inputs = Store(spark, root, cfg, keep), ":".join(str(fingerprint(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")) for t in INPUTS)
    old = store.manifest()
    if old is not None and old["inputs"] == inputs and old["config"] == store.config_key():
        return StoredSources(store, sf_dir, old)
    plain = S.sales(spark, sf_dir, cfg)
    sales = plain.withColumn("slice", F.col("year").cast("string"))
    if old is None or old["config"] != store.config_key():
        sources = None  # nothing to compare with
    else:
        sources = year_sources(plain)
        # a first load has left its rows' fingerprint to be taken from the stored rows
        late = {s for s, v in old["slices"].items() if not v["source"]}
        if late:
            had = year_sources(store.transactions(old, keyed=True).where(F.col("year").isin(*map(int, late))).select(*plain.columns))
            for s in late:
                old["slices"][s]["source"] = had[s]

    def dimensions(s: Store, m: dict):
        src = StoredSources(s, sf_dir, m)
        keyed = s.transactions(m, keyed=True).where(~F.col("not_full_market"))
        aff = schemas.at_rest(S.affordability_from(src.profile(), S.places(spark, sf_dir), src.customer()), schemas.AFFORDABILITY)
        yield "affordability", aff
        yield "supply_demand", schemas.at_rest(S.supply_demand_from(keyed), schemas.SUPPLY_DEMAND)
        yield "investment_scores", schemas.at_rest(DerivedSources.scores(src), schemas.INVESTMENT_SCORES)

    m = store.sync(sources, lambda years: sales if years is None else sales.where(F.col("slice").isin(*years)), dimensions, inputs, old)
    return StoredSources(store, sf_dir, m)


def sync_registers(spark: SparkSession, directory: str, years, affordability_csv: str, supply_csv: str, root: str, cfg: Config = DEFAULT,
                   scores_csv: str | None = None, keep: int = 2) -> StoredSources:
    """Bring the store at ``root`` up to a folder of yearly registers and the dimension files.

    Only files that changed by size or time are read again.
    """
    from .register import read_register, register_path

    store = Store(spark, root, cfg, keep)
    sources = {str(y): f for y in years if (f := fingerprint(spark, register_path(directory, y)))}
    inputs = ":".join(str(fingerprint(spark, p)) for p in (affordability_csv, supply_csv, scores_csv) if p)

    def load(slices):
        from functools import reduce
        return reduce(DataFrame.unionByName, [read_register(spark, directory, [int(y)], cfg).withColumn("slice", F.lit(y)) for y in slices])

    def dimensions(s: Store, m: dict):
        src = StoredSources(s, manifest=m)
        yield "affordability", read_dimension_csv(spark, affordability_csv, schemas.AFFORDABILITY)
        yield "supply_demand", read_dimension_csv(spark, supply_csv, schemas.SUPPLY_DEMAND)
        scores = schemas.for_jobs(read_scores_csv(spark, scores_csv, cfg)) if scores_csv else DerivedSources.scores(src)
        yield "investment_scores", schemas.at_rest(scores, schemas.INVESTMENT_SCORES)

    return StoredSources(store, manifest=store.sync(sources, load, dimensions, inputs))


def register_views(src: DerivedSources, cfg: Config = DEFAULT) -> None:
    """Typed temp views for ``spark.sql``: transactions, affordability, supply_demand, investment_scores."""
    for name in schemas.TABLES:
        src.at_rest(name).createOrReplaceTempView(name)


class RegisterSources(DerivedSources):
    """A real deployment: the clean transactions table plus the two stored dimension CSVs."""

    def __init__(self, spark: SparkSession, transactions_path: str, affordability_csv: str, supply_csv: str,
                 cfg: Config = DEFAULT, scores_csv: str | None = None):
        super().__init__(spark, "", cfg)
        self.scores_csv = scores_csv
        self.transactions_path, self.affordability_csv, self.supply_csv = transactions_path, affordability_csv, supply_csv

    def tx(self) -> DataFrame:
        return read_transactions(self.spark, self.transactions_path)

    def aff(self) -> DataFrame:
        return schemas.for_jobs(read_dimension_csv(self.spark, self.affordability_csv, schemas.AFFORDABILITY))

    def sd(self) -> DataFrame:
        return schemas.for_jobs(read_dimension_csv(self.spark, self.supply_csv, schemas.SUPPLY_DEMAND))

    def scores(self) -> DataFrame:
        """The stored scores and tiers where they are given, else derived from the dimensions."""
        return schemas.for_jobs(read_scores_csv(self.spark, self.scores_csv, self.cfg)) if self.scores_csv else super().scores()

    def profiles(self, *only: str) -> DataFrame:
        """All profiles at once, from two reads of the clean table, whichever job asks first."""
        return super().profiles(*P.NAMES).where(F.col("profile").isin(*only))

    def customer(self) -> DataFrame:
        raise NotImplementedError("register_cleaning runs on the driver's customer table only")


# ---------------------------------------------------------------------------
# Load once per session: the driver-contract queries store the canonical tables
# on first use and every later job reads them.
# ---------------------------------------------------------------------------
_STORES: dict[tuple, StoredSources] = {}
_LOCK = threading.Lock()
#: Setting that names a lasting store for the driver-contract queries; else each session makes its own.
STORE = "spark.brickyard.store"
INPUTS = ("orders", "customer", "nation", "region")


def _fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Modification time and size of every input, so changed inputs are never served stale."""
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    out = []
    for t in INPUTS:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        fs = p.getFileSystem(conf)
        files = fs.listFiles(p, True)  # nested partitions too
        while files.hasNext():
            st = files.next()
            out.append((str(st.getPath()), st.getModificationTime(), st.getLen()))
    return tuple(sorted(out))


def stored_for(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT) -> DerivedSources:
    """Canonical tables of ``sf_dir`` stored once per session under ``spark.checkpoint.dir``.

    Falls back to deriving on use where no SparkContext is reachable (Spark Connect).
    """
    try:
        app = spark.sparkContext.applicationId
    except Exception:
        return DerivedSources(spark, sf_dir, cfg)
    from ..session import ensure_checkpoint_dir
    key = (app, sf_dir.rstrip("/"), cfg, _fingerprint(spark, sf_dir))
    with _LOCK:
        src = _STORES.get(key)
        if src is None:
            root = ensure_checkpoint_dir(spark).rstrip("/")
            src = materialize(spark, sf_dir, spark.conf.get(STORE, "") or f"{root}/canonical-{uuid.uuid4().hex}", cfg)
            _STORES[key] = src
        return src
