"""Sinks: cleaned and masked files, database tables, load manifest."""

from __future__ import annotations

import hashlib
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from statloom.functions.frames import col, local_table
from statloom.operators.pii import mask_columns, pii_map

DATABASE_PREFIX = "csv_"
INSERT_BATCH = 1000


def _write(df: DataFrame, path: str, fmt: str) -> str:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_cleaned(df: DataFrame, folder: str, name: str, fmt: str = "parquet") -> str:
    return _write(df, os.path.join(folder, f"cleaned_{name}"), fmt)


def write_masked(df: DataFrame, folder: str, name: str, fmt: str = "parquet",
                 pii: dict[str, str] | None = None, salt: str | None = None) -> str | None:
    """Write the masked copy; nothing is written when no PII was found."""
    pii = pii_map(df) if pii is None else pii
    if not pii:
        return None
    return _write(mask_columns(df, pii, salt), os.path.join(folder, f"masked_cleaned_{name}"), fmt)


def safe_column_names(names: list[str]) -> list[str]:
    """Letters, digits and underscores only; repeats get _1, _2, ... and never collide."""
    clean = [re.sub(r"[^a-zA-Z0-9_]", "_", n).strip("_") or "column" for n in names]
    used: set[str] = set()
    out = []
    for name in clean:
        candidate, k = name, 0
        # the catalog ignores case, so names must differ beyond case
        while candidate.lower() in used or (k > 0 and candidate in clean):
            k += 1
            candidate = f"{name}_{k}"
        used.add(candidate.lower())
        out.append(candidate)
    return out


def sanitise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*safe_column_names(df.columns))


def _squeeze(text: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", text.lower())).strip("_")


def database_name(filename: str) -> str:
    """csv_<stem, 40 chars>_<6 hex digits>, the same for the same file name."""
    stem = os.path.splitext(os.path.basename(filename))[0]
    tag = hashlib.md5(stem.lower().encode()).hexdigest()[:6]
    return f"{DATABASE_PREFIX}{_squeeze(stem)[:40]}_{tag}"


def table_name(raw: str) -> str:
    name = _squeeze(raw)
    return (f"t_{name}" if name[:1].isdigit() else name)[:64]


#: Names of tables never hold two underscores in a row, so these parts cannot meet one.
STAGED, LOADED = "__staged_", "loaded__"


def _own(name: str) -> str:
    if not re.fullmatch(DATABASE_PREFIX + r"[a-z0-9_]+", name):
        raise ValueError(f"refusing to touch database {name!r}: not created here")
    return name


def drop_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS `{_own(name)}` CASCADE")


def create_database(spark: SparkSession, name: str) -> str:
    """Create a fresh database, dropping an earlier one of the same name.

    It gets a folder of its own: files left behind by a catalog that has since
    been lost cannot get in the way.
    """
    drop_database(spark, name)
    folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), f"{name}-{uuid.uuid4().hex[:12]}.db")
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{folder}'")
    return name


def designed_tables(df: DataFrame, design: dict | None, default: str) -> list[tuple[str, DataFrame]]:
    """(table name, frame) per table spec; the whole frame under `default` without a design.

    A spec projects its known source columns and keeps distinct rows; a spec
    without known columns gets the full frame as it is.
    """
    specs = (design or {}).get("tables") or []
    if not specs:
        return [(table_name(default), df)]
    out = []
    for spec in specs:
        names = [c for c in spec.get("source_columns", []) if c in df.columns]
        frame = df.select(*[col(c) for c in names]).distinct() if names else df
        out.append((table_name(spec.get("name", "data")), frame))
    return out


MANIFEST = "db_name string, table_name string, columns string, column_count int, row_count long, total_rows long, rationale string"


def _tables_of(spark: SparkSession, db: str) -> list[str]:
    return [t.name for t in spark.catalog.listTables(db)] if spark.catalog.databaseExists(db) else []


def stage_tables(df: DataFrame, filename: str, design: dict | None = None) -> DataFrame:
    """Write the tables of a load beside those of the last one, then the manifest as the sign that all are there.

    A load that fails on the way takes its tables back; nobody has seen them.
    """
    spark, db, run = df.sparkSession, database_name(filename), uuid.uuid4().hex[:12]
    if not spark.catalog.databaseExists(db):
        create_database(spark, db)
    loaded = []
    try:
        for name, frame in designed_tables(df, design, re.sub(r"\.csv$", "", os.path.basename(filename))):
            staged = f"`{db}`.`{name}{STAGED}{run}`"
            frame.write.mode("overwrite").format("parquet").saveAsTable(staged)
            rows = spark.table(staged).count()  # from file footers
            loaded.append((db, name, ", ".join(frame.columns), len(frame.columns), rows))
        manifest = _manifest(spark, loaded, design)
        manifest.coalesce(1).write.format("parquet").saveAsTable(f"`{db}`.`{LOADED}{run}`")
    except BaseException:
        for table in _tables_of(spark, db):
            if table.endswith(run):
                spark.sql(f"DROP TABLE IF EXISTS `{db}`.`{table}`")
        raise
    return manifest


def settle_load(spark: SparkSession, filename: str) -> bool:
    """Bring the database of a file into one state after a load, whether or not that came to its end.

    A load whose manifest stands is swapped in table by table: the old one is dropped, the new one takes its name, and
    tables that the load does not have go.  Repeating that from any point gives the same database, so a driver lost
    in between is made good by the next call.  Staged tables without a manifest are dropped.  True if a load came in.
    """
    db = _own(database_name(filename))
    tables = set(_tables_of(spark, db))
    signs = [t for t in tables if t.startswith(LOADED)]
    for sign in signs:
        run = sign.removeprefix(LOADED)
        names = {r["table_name"] for r in spark.table(f"`{db}`.`{sign}`").collect()}  # a row per table of the design
        for old in [t for t in tables if "__" not in t and t not in names]:
            spark.sql(f"DROP TABLE IF EXISTS `{db}`.`{old}`")
        for name in sorted(names):
            if (staged := f"{name}{STAGED}{run}") in tables:
                spark.sql(f"DROP TABLE IF EXISTS `{db}`.`{name}`")
                spark.sql(f"ALTER TABLE `{db}`.`{staged}` RENAME TO `{db}`.`{name}`")
        spark.sql(f"DROP TABLE `{db}`.`{sign}`")
    for left in [t for t in _tables_of(spark, db) if STAGED in t]:
        spark.sql(f"DROP TABLE IF EXISTS `{db}`.`{left}`")
    return bool(signs)


def load_tables(df: DataFrame, filename: str, design: dict | None = None, mask: bool = True,
                pii: dict[str, str] | None = None, salt: str | None = None) -> DataFrame:
    """Load the frame into the database of its file name and return the manifest, one row per table.

    Personal data is masked unless mask=False.  The tables are staged first and swapped in when all of them are
    written, so a load that fails leaves those of the last one as they were.  One load of a file name at a time.
    """
    spark = df.sparkSession
    if df.isEmpty():
        raise ValueError("Cannot load an empty DataFrame.")
    if mask:
        df = mask_columns(df, pii_map(df) if pii is None else pii, salt)
    settle_load(spark, filename)
    manifest = stage_tables(sanitise_columns(df), filename, design)
    settle_load(spark, filename)
    return manifest


def plan_manifest(df: DataFrame, filename: str, design: dict | None = None) -> DataFrame:
    """The manifest a load would give, without writing anything."""
    df = sanitise_columns(df)
    db = database_name(filename)
    parts = [
        (db, name, ", ".join(frame.columns), len(frame.columns), frame.count())
        for name, frame in designed_tables(df, design, re.sub(r"\.csv$", "", os.path.basename(filename)))
    ]
    return _manifest(df.sparkSession, parts, design)


def _manifest(spark: SparkSession, tables: list[tuple], design: dict | None) -> DataFrame:
    total = sum(t[4] for t in tables)
    why = (design or {}).get("rationale", "Auto-loaded as single table")
    return local_table(spark, [(*t, total, why) for t in tables], MANIFEST)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None,
               batch: int = INSERT_BATCH, connections: int = 16) -> None:
    """Replace a JDBC table with batched inserts over at most `connections` sessions."""
    options = {"batchsize": str(batch), **(properties or {})}
    # a shuffle to few writers: coalesce would squeeze the whole job into them
    df.repartition(connections).write.mode("overwrite").jdbc(url, table, properties=options)
