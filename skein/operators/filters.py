"""Predicates over files: location, type, date; the exclusion policy; the longest matching root."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import extension, fold_width


def under(path: Column, prefix: str) -> Column:
    """Below a folder; the folder itself isn't."""
    return F.startswith(path, F.lit(prefix.rstrip("/") + "/"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)


@dataclass(frozen=True)
class Filters:
    """What a search is limited to. Empty sets and absent dates don't limit."""

    root_ids: frozenset[str] = frozenset()
    path_prefixes: frozenset[str] = frozenset()
    extensions: frozenset[str] = frozenset()
    after: str | None = None
    before: str | None = None

    def locations(self) -> Column:
        """Roots and folders widen one another."""
        own = [F.col("root_id").isin(*sorted(self.root_ids))] if self.root_ids else []
        return any_of(own + [under(F.col("path"), p) for p in sorted(self.path_prefixes)])

    def types(self) -> Column:
        return F.lower("extension").isin(*sorted(e.lower() for e in self.extensions)) if self.extensions else F.lit(True)

    def dates(self, modified: Column | None = None) -> Column:
        """Both ends count. An unknown date fails a limit."""
        m = F.col("modified_at") if modified is None else modified
        out = F.lit(True)
        if self.after:
            out = out & F.coalesce(m >= F.lit(self.after).cast("timestamp_ntz"), F.lit(False))
        if self.before:
            out = out & F.coalesce(m <= F.lit(self.before).cast("timestamp_ntz"), F.lit(False))
        return out

    def column(self) -> Column:
        return self.locations() & self.types() & self.dates()

    def column_v2(self) -> Column:
        """The second ranker's rules: roots and folders narrow one another, a folder itself counts, an unknown date is the epoch."""
        path = F.regexp_replace("path", "^/private/var(/|$)", "/var$1")
        out = F.col("root_id").isin(*sorted(self.root_ids)) if self.root_ids else F.lit(True)
        out = out & any_of([under(path, p) | (path == p) for p in sorted(self.path_prefixes)])
        return out & self.types() & self.dates(F.coalesce("modified_at", F.lit("1970-01-01").cast("timestamp_ntz")))


def resolve_roots(wanted: DataFrame, roots: DataFrame) -> DataFrame:
    """Root ids as path prefixes where the root is known, else as they are."""
    return wanted.join(roots.select("root_id", F.col("path").alias("prefix")), "root_id", "left")


def longest_root(rows: DataFrame, roots: DataFrame, key: str = "source_id") -> DataFrame:
    """Each row with the longest root that its path lies in; rows in no root go. A row is joined only with its own ancestors."""
    steps = F.size(F.split("path", "/"))
    above = F.transform(F.sequence(F.lit(2), steps), lambda n: F.concat_ws("/", F.slice(F.split("path", "/"), 1, n)))
    own = rows.select("*", F.explode(above).alias("root_path"))
    named = own.join(roots.select(F.col("root_id").alias("matched_root"), F.col("path").alias("root_path")), "root_path")
    w = Window.partitionBy(key).orderBy(F.length("root_path").desc(), "matched_root")
    return named.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


# Folders and file types that an index leaves out.
FOLDERS = """.git .svn .hg .Trash .ssh .gnupg node_modules bower_components jspm_packages DerivedData Pods Carthage .build .swiftpm
.dart_tool .gradle .next .nuxt .turbo __pycache__ .pytest_cache .mypy_cache .tox .venv venv site-packages Caches Cache tmp Temp""".split()
COMPONENTS = ["Keychains"]
SEQUENCES = [["go", "pkg", "mod"], ["vendor", "bundle"]]
LIBRARY = ["CloudStorage", "Mobile Documents"]
SOURCE_CODE = """swift m mm h hpp c cc cpp rs go py rb js jsx ts tsx java kt kts php cs fs fsx vb scala sc lua r dart ex exs erl hrl clj
cljs cljc groovy gradle vue svelte zig sol asm s pl pm sh bash zsh fish sql css scss less json jsonl""".split()


@dataclass(frozen=True)
class Policy:
    exclude_source_code: bool = True
    prefixes: tuple[str, ...] = ()
    home: str = ""
    folders: tuple[str, ...] = field(default=tuple(FOLDERS + COMPONENTS))

    def excluded(self, path: Column, root: Column) -> Column:
        """Whether a file is left out of the index of a root."""
        inside = F.startswith(path, F.concat(root, F.lit("/")))
        relative = F.lower(fold_width(F.substring(path, F.length(root) + 2, F.length(path))))
        parts = F.split(relative, "/")
        folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        joined = F.concat(F.lit("/"), F.array_join(folders, "/"), F.lit("/"))
        out = ~inside | F.arrays_overlap(folders, F.array(*(F.lit(f.lower()) for f in self.folders)))
        out = out | any_of([F.contains(joined, F.lit("/" + "/".join(s) + "/")) for s in SEQUENCES])
        for p in self.prefixes:
            out = out | (path == p) | under(path, p)
        if self.exclude_source_code:
            out = out | extension(path).isin(*SOURCE_CODE)
        if self.home:
            allowed = F.coalesce(F.try_element_at(folders, F.lit(2)).isin(*(x.lower() for x in LIBRARY)), F.lit(False))
            out = out | ((root == self.home) & (F.coalesce(F.try_element_at(folders, F.lit(1)), F.lit("")) == "library") & ~allowed)
        return F.coalesce(out, F.lit(False))


# File types by their group in a filter menu.
TYPE_GROUPS = {
    "PDF": ["pdf"], "DOC / DOCX": ["doc", "docx", "docm"], "XLS / XLSX": ["xls", "xlsx", "xlsm", "xlsb"],
    "PPT / PPTX": ["ppt", "pps", "pot", "pptx", "pptm", "ppsx", "ppsm"], "MD": ["md"], "TXT": ["txt"],
    "JPG": ["jpg", "jpeg"], "PNG": ["png"], "HEIC": ["heic"], "TIFF": ["tif", "tiff"],
}


def type_group(ext: Column) -> Column:
    return reduce(lambda out, g: out.when(F.lower(ext).isin(*g[1]), g[0]), list(TYPE_GROUPS.items())[1:], F.when(F.lower(ext).isin("pdf"), "PDF")).otherwise("other")


def date_presets(now: Column) -> Column:
    """name -> the earliest time of the past day, week, month and year."""
    back = {"day": "1 day", "week": "7 days", "month": "1 month", "year": "1 year"}
    return F.create_map(*(x for k, v in back.items() for x in (F.lit(k), now - F.expr(f"interval {v}"))))
