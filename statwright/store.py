"""The ledger on disk: Parquet folders, and numbered manifests that list those of each table.

A commit writes new folders, then one new manifest that lists them beside the
folders of the last one; the manifest comes into being by a rename, so readers
see the state before or after, and a commit that stops half-way leaves only
folders that no manifest names. An import adds its own rows; nothing that is
there is written again, but for tables of more than FOLDERS folders, which a
commit joins into one. The import log keeps a row a file, by content hash;
transactions carry content ids, so an import that runs twice adds nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statwright.functions import categories
from statwright.operators import ledger as lg
from statwright.sources import statements as st

LEDGER = (
    "id string, account string, posted_on date, amount_cents bigint, currency string, raw_description string, merchant string, category string, source_file string, source_row int, occurrence int,"
    " original_amount_cents bigint, original_currency string, fx_rate double, country string, is_fee boolean, file_hash string"
)
LOG = (
    "file_hash string, path string, imported_at timestamp, rows_read bigint, rows_inserted bigint, rows_skipped bigint,"
    " layout string, date_format string, day_first boolean, date_confidence double, sign_mode string, negative_is_outflow boolean"
)
ACCOUNTS = "account string, currency string"
TABLES = {"ledger": LEDGER, "log": LOG, "accounts": ACCOUNTS}
#: Folders of a table beyond which a commit joins them, and errors that a result shows a file.
FOLDERS, ERRORS = 200, 5


@dataclass
class Store:
    spark: SparkSession
    root: str

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The number of the last manifest; 0 for an empty store."""
        fs, p = self._fs(f"{self.root}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n)), default=0)

    def folders(self) -> dict[str, list[str]]:
        """The folders of each table in the current version."""
        v = self.version()
        if not v:
            return {name: [] for name in TABLES}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{v}.json", wholetext=True).first()[0])

    def read(self, name: str) -> DataFrame:
        """A table of the current version; columns that older folders lack are null."""
        paths = [f"{self.root}/{x}" for x in self.folders()[name]]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def ledger(self) -> DataFrame:
        return self.read("ledger")

    def log(self) -> DataFrame:
        """The latest entry of each file."""
        log = self.read("log")
        last = log.groupBy("file_hash").agg(F.max_by(F.struct(*[c for c in log.columns if c != "file_hash"]), "imported_at").alias("r"))
        return last.select("file_hash", "r.*")

    def accounts(self) -> DataFrame:
        return self.read("accounts")

    def _written(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, replace: dict[str, DataFrame] | None = None, **add: DataFrame) -> int:
        """Adds rows to tables, or replaces tables as a whole, in one new version."""
        v, now = self.version() + 1, self.folders()
        for name, df in add.items():
            now[name] = [*now[name], self._written(name, df)]
        for name, df in (replace or {}).items():
            now[name] = [self._written(name, df)]
        for name, folders in now.items():
            if len(folders) > FOLDERS:
                now[name] = [self._written(name, self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{x}" for x in folders]))]
        fs, tmp = self._fs(f"{self.root}/manifests/{uuid.uuid4().hex}.part")
        out = fs.create(tmp, False)
        out.write(json.dumps(now).encode())
        out.close()
        _, to = self._fs(f"{self.root}/manifests/{v}.json")
        if fs.exists(to) or not fs.rename(tmp, to):
            fs.delete(tmp, False)
            raise OSError(f"another commit to {self.root} came first; import again")
        return v

    def import_path(self, path: str, force: bool = False, rules: list[categories.CategoryRule] = categories.BUILTIN, override: st.Override | None = None) -> list[dict]:
        """Imports a folder or a file; a row a file of what happened. Known files are skipped unless forced; a failed one is not logged."""
        if override is None:
            fs, p = self._fs(path)
            override = st.load_override(self.spark, path) if fs.getFileStatus(p).isDirectory() else st.Override()
        return self.import_files(st.read_files(self.spark, path), force, rules, override)

    def import_files(self, files: DataFrame, force: bool = False, rules: list[categories.CategoryRule] = categories.BUILTIN, override: st.Override = st.Override()) -> list[dict]:  # noqa: B008
        """The same of files (path, source_file, file_hash, content), in one commit. What is collected is a row a file and ERRORS errors of each."""
        fresh = files if force else lg.new_files(files, self.log())
        rows = st.read_rows(fresh, override).persist()
        known = files.select("source_file", "file_hash").collect()
        new, bad = st.normalized(rows, override, rules, "detail")
        new = new.persist()
        added = lg.insert_ignore(self.ledger(), new).persist()
        by = Window.partitionBy("source_file")
        errors: dict[str, list] = {}
        first = bad.withColumn("nth", F.row_number().over(by.orderBy("source_row", "error"))).withColumn("all", F.count("*").over(by)).where(F.col("nth") <= ERRORS)
        for r in sorted(first.collect(), key=lambda r: (r["source_file"], r["nth"])):
            errors.setdefault(r["source_file"], [r["all"]]).append(r["error"] if r["source_row"] is None else f"row {r['source_row']}: {r['error']}")
        read = rows.where("error IS NULL").groupBy("source_file", "file_hash", "path", "account").agg(F.count("*").alias("rows_read"))
        decided = read.join(st.decisions(rows, override), "path", "left")
        counted = decided.join(added.groupBy("source_file").agg(F.count("*").alias("rows_inserted")), "source_file", "left").withColumn("rows_inserted", F.coalesce("rows_inserted", F.lit(0))).collect()
        named = {x["file_hash"] for x in new.select("file_hash").distinct().collect()}
        done = [r for r in counted if r["file_hash"] in named]
        plan = ("layout", "date_format", "day_first", "date_confidence", "sign_mode", "negative_is_outflow")
        if done:
            at = datetime.now(timezone.utc).replace(tzinfo=None)
            entries = self.spark.createDataFrame([(r["file_hash"], r["path"], at, r["rows_read"], r["rows_inserted"], r["rows_read"] - r["rows_inserted"], *[r[k] for k in plan]) for r in done], LOG)
            self.commit(ledger=added, log=entries, accounts=lg.accounts_to_add(self.accounts(), new, override.currency or "USD"))
        by_file, checks = {r["source_file"]: r for r in counted}, st.printed_totals(rows)
        out = []
        for f in sorted(known, key=lambda r: r["source_file"]):
            name = f["source_file"]
            r, errs = by_file.get(name), errors.get(name, [0])
            n, ins = (r["rows_read"], r["rows_inserted"]) if r else (0, 0)
            out.append({
                "file": name, "account": r["account"] if r else None, "rows_read": n, "rows_inserted": ins, "rows_skipped": n - ins, "already_imported": r is None and not errs[0], "errors": errs[1:], "error_count": errs[0],
                "plan": {k: json.loads(r[k]) if k == "layout" and r[k] else r[k] for k in plan} if r else None, "reconciliation": checks.get(name, []),
            })
        for df in (rows, new, added):
            df.unpersist()
        return out

    def recategorize(self, rules: list[categories.CategoryRule] = categories.BUILTIN) -> dict[str, int]:
        """New rules for rows already there; a new version only if some row changes."""
        ruled = lg.recategorized(self.ledger(), rules)
        seen = ruled.agg(F.count("*").alias("examined"), F.count_if("changed").alias("changed")).first().asDict()
        if seen["changed"]:
            self.commit({"ledger": ruled.drop("changed")})
        return seen
