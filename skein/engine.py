"""The engine: an index as segments in a folder, built from files, kept up to date, and searches over it.

An index is what its newest manifest names. Each build or change writes a new segment (files, passages, postings) and a
table of tombstones, then the manifest, so a search sees one generation whole and a failed job leaves the last one as it
was. A manifest is published only where no other writer was first; else the change is made anew on top of the other's.
Statistics are kept exact: what a change takes away is counted before it goes. `compact` merges segments and removes
what no manifest in use names. Vectors are a snapshot, a quantised index, and what was embedded since. An index for
semantic searches alone can be built without words: it has no postings, which are most of the work, and refuses text searches.
One that is loaded by several changes before its first search can be built so too, and get its words when it is merged.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.chunking import chunk_rows
from skein.functions.embedding import DIMENSIONS, embed_column, embed_texts
from skein.operators import expression
from skein.operators import filters as X
from skein.operators import inverted
from skein.operators import maintenance as M
from skein.operators import quantised
from skein.operators import vectors as V
from skein.operators.query import Query, parse
from skein.sources import discovery, extract
from skein.sources.manifest import Log, Manifest, listed, remove

MODES = ("text", "semantic", "hybrid")
IMAGES = ("png", "jpg", "jpeg", "heic", "tif", "tiff")
SEGMENTS = 8  # with more than so many, a change is followed by a merge
FEW = 200_000  # rows that may be sent to all
NAMED = 20_000  # changed files that are read by their names; more are read by a scan of their root


NO_VECTORS = {"snapshot": None, "deltas": (), "n_snapshot": 0, "embedded": 0}


@dataclass(frozen=True)
class SearchRequest:
    """What to search for; limit and weight are kept within 1 to 200 and 0 to 1."""

    query: str
    mode: str = "text"
    filters: X.Filters = field(default_factory=X.Filters)
    limit: int = 20
    semantic_weight: float = 0.35
    cursor: str | None = None
    ranker: int = 1
    group_copies: bool = False
    exact: bool = False  # compare all vectors; else those that the quantised index of the snapshot puts nearest

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        object.__setattr__(self, "limit", max(1, min(200, self.limit)))
        object.__setattr__(self, "semantic_weight", max(0.0, min(1.0, self.semantic_weight)))


class StaleCursor(ValueError):
    """The index has changed since the cursor was given."""


def _worded(text: str) -> Query:
    """What snippets of an expression show: its words and phrases but for exclusions."""
    found = [" ".join(x.words) for x in expression.leaves(expression.parse(text))]
    return Query((), highlights=tuple(found))


def effective_mode(requested: str, ready: bool) -> str:
    """Without vectors every search is a text search."""
    return requested if ready else "text"


class Engine:
    """An index below `base`."""

    def __init__(self, spark: SparkSession, base: str, policy: X.Policy | None = None, recipes: dict[str, int] | None = None):
        """recipes: the version of extraction by file type, 0 where there is none; files extracted by an older one are read again."""
        self.spark, self.base, self.policy = spark, base.rstrip("/"), policy or X.Policy()
        self.recipes = extract.RECIPES if recipes is None else recipes
        self.log = Log(spark, self.base)
        self._snapshots: dict[str, quantised.Index] = {}  # of the last snapshot searched

    def generation(self) -> int:
        return self.log.current().generation

    # --- reading what is live ---

    def _live(self, m: Manifest, rows: DataFrame) -> DataFrame:
        """rows(source_id, sequence, ...) without those that a later change replaced or deleted."""
        if not m.tombstones:
            return rows
        dead = self.spark.read.parquet(f"{self.base}/{m.tombstones}/sources")
        dead = F.broadcast(dead) if m.n_tombstones <= FEW else dead
        return rows.join(dead.withColumnRenamed("source_id", "_gone"), (F.col("source_id") == F.col("_gone")) & (F.col("sequence") <= F.col("upto")), "left_anti")

    def _table(self, name: str, m: Manifest | None = None, schema: str | None = None) -> DataFrame:
        m = m or self.log.current()
        if not m.segments:
            raise LookupError("there is no index here yet")
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        parts = [reader.parquet(f"{self.base}/{s}/{name}").withColumn("sequence", F.lit(n)) for s, n in m.segments.items()]
        return self._live(m, reduce(DataFrame.unionByName, parts))

    def files(self) -> DataFrame:
        return self._table("files")

    def passages(self) -> DataFrame:
        return self._table("passages")

    def index_of(self, m: Manifest) -> inverted.Index:
        if not m.words:
            raise LookupError("this index was built without words; it answers semantic searches only")
        rows = self._table("postings", m, inverted.POSTINGS)
        blocks = reduce(DataFrame.unionByName, (self.spark.read.schema(inverted.BLOCKS).parquet(f"{self.base}/{s}/blocks") for s in m.segments))
        return inverted.Index(rows, m.counts, self._dictionary(m), blocks)

    def _dictionary(self, m: Manifest) -> DataFrame:
        """All segments' terms, and those of what is gone from them with counts below zero."""
        at = [*m.segments, *([f"{m.tombstones}"] if m.tombstones else [])]
        return reduce(DataFrame.unionByName, (self.spark.read.schema(inverted.TERMS).parquet(f"{self.base}/{x}/terms") for x in at))

    # --- building ---

    def index_folder(self, root: str, root_id: str = "root", parser: Callable = extract.parse) -> int:
        """Index the files below a folder that the policy doesn't exclude."""
        m = self.index(self.read_folder(root, root_id, parser), {root_id: discovery.plain_path(root)})
        return m.generation

    def read_folder(self, root: str, root_id: str = "root", parser: Callable = extract.parse, paths: list[str] | None = None) -> DataFrame:
        """Files and their texts, of all below a folder or of some paths. Contents are read where the listing is, in one scan, so a date belongs to its text; files over the size limit aren't read at all."""
        kept = discovery.discover(self.spark, root, root_id, content=True, paths=paths).filter(~self._left_out(root))
        plain = F.when(~extract.looks_binary(F.col("content")), extract.decode_text(F.col("content")))
        rows = extract.extract_structured(kept.drop("availability"), parser).drop("availability")
        rows = rows.withColumn("text", F.coalesce("text", F.when(F.col("error") == "unsupported", plain)))
        rows = rows.withColumn("availability", extract.extraction_status(F.when(F.col("error") != "unsupported", F.col("error")), F.col("text")))
        return rows.drop("content", "error").withColumns({"modified_at": F.col("modified_at").cast("timestamp_ntz"), "extraction_version": self._recipe()})

    def _left_out(self, root: str) -> Column:
        return self.policy.excluded(F.col("path"), F.lit(discovery.plain_path(root)))

    def _recipe(self) -> Column:
        out = F.lit(0)
        for ext, version in self.recipes.items():
            out = F.when(F.lower("extension") == ext, version).otherwise(out)
        return out

    def _segment(self, rows: DataFrame, name: str, words: bool = True) -> dict[str, int]:
        """Write a segment from files with their texts, with postings or without, and count it."""
        at = f"{self.base}/{name}"
        title = T.first_words(F.col("text"), 6)
        rows = rows if "extraction_version" in rows.columns else rows.withColumn("extraction_version", self._recipe())
        rows.drop("error").withColumn("title", title).withColumn("folder", T.parent(F.col("path"))).write.parquet(f"{at}/source")
        source = self.spark.read.parquet(f"{at}/source")
        files = source.drop("text")
        files.write.parquet(f"{at}/files")
        has = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
        cut = chunk_rows(source.filter(has), "source_id", "text")
        empty = source.filter(~has).select("source_id", F.lit(0).alias("ordinal"), F.lit("").alias("body"))
        p = cut.unionByName(empty)  # a file without text is found by its name
        kind = F.when(F.col("extension").isin(*IMAGES), "image").otherwise("section")
        p = p.withColumn("passage_id", F.xxhash64("source_id", "ordinal")).join(files.select("source_id", "root_id", "path", "filename", "title", "folder", "extension", "modified_at", "availability"), "source_id").withColumn("location_kind", kind)
        p.repartitionByRange("passage_id").sortWithinPartitions("passage_id").write.parquet(f"{at}/passages")
        remove(self.spark, f"{at}/source")
        return self._words(name) if words else {"n": self.spark.read.parquet(f"{at}/passages").count()}

    def _words(self, name: str) -> dict[str, int]:
        """Write the postings of a segment's passages, and count it."""
        at = f"{self.base}/{name}"
        inverted.write(self.spark.read.parquet(f"{at}/passages"), at)
        return inverted.Index.read(self.spark, at).counts

    def index(self, rows: DataFrame, roots: dict[str, str] | None = None, words: bool = True) -> Manifest:
        """Build anew from files with their texts: source_id, root_id, path, filename, extension, modified_at, size, availability, text.

        Without words no postings are made, then or by later changes: for semantic searches alone, or until `compact` makes them.
        """
        name = f"segment-{uuid4().hex}"
        counts = self._segment(rows, name, words)

        def change(m: Manifest) -> Manifest:
            fresh = Manifest(generation=m.generation, batch=m.batch, words=words)
            return fresh.after(sequence=m.sequence + 1, segments={name: m.sequence + 1}, counts=counts, roots=(m.roots | roots) if roots else m.roots)

        return self.log.advance(change)

    def apply(self, rows: DataFrame | None = None, gone: DataFrame | None = None, batch: int | None = None) -> Manifest:
        """Put in files with their texts, in place of what is there of the same source, and take out the sources `gone`(source_id)."""
        m = self.log.current()
        if batch is not None and batch <= m.batch:
            return m  # a batch that comes again has been applied
        if not m.segments and rows is None:
            return m
        name, at = f"segment-{uuid4().hex}", f"tombstones-{uuid4().hex}"
        new = self._segment(rows, name, m.words) if rows is not None else None
        if new is not None and not new["n"]:  # a segment of nothing
            remove(self.spark, f"{self.base}/{name}")
            rows = new = None
        touched = [self.spark.read.parquet(f"{self.base}/{name}/files").select("source_id")] if new else []
        touched += [gone.select("source_id")] if gone is not None else []
        tries = iter(range(1000))

        def change(m: Manifest) -> Manifest:
            nonlocal new
            if batch is not None and batch <= m.batch:
                return m
            if new and m.words and new.keys() == {"n"}:  # another writer has built anew, with words
                new = self._words(name)
            segments, counts, dead, number = dict(m.segments), dict(m.counts), m.tombstones, m.n_tombstones
            if m.segments and touched:
                mine = f"{at}-{next(tries)}"
                ids = reduce(DataFrame.unionByName, touched).distinct()
                own = self._table("files", m).select("source_id").join(ids, "source_id", "left_semi").withColumn("upto", F.lit(m.sequence))
                before = [self.spark.read.parquet(f"{self.base}/{m.tombstones}/sources")] if m.tombstones else []
                reduce(DataFrame.unionByName, [own, *before]).groupBy("source_id").agg(F.max("upto").alias("upto")).write.parquet(f"{self.base}/{mine}/sources")
                stones = self.spark.read.parquet(f"{self.base}/{mine}/sources")
                fresh = stones.filter(F.col("upto") == m.sequence).select("source_id")
                if not new and batch is None and fresh.isEmpty():  # nothing that is there goes
                    remove(self.spark, f"{self.base}/{mine}")
                    return m
                passages = self._table("passages", m).join(fresh, "source_id", "left_semi")
                old = inverted.statistics(passages).first().asDict() if m.words else {"n": passages.count()}
                if m.words:
                    self._write_lost_terms(m, passages, f"{self.base}/{mine}/terms")
                counts, dead, number = {k: counts[k] - old[k] for k in counts}, mine, stones.count()
            if new:
                counts = {k: counts.get(k, 0) + new[k] for k in new if m.words or k == "n"}
                segments[name] = m.sequence + 1
            elif batch is None and dead == m.tombstones:
                return m
            return m.after(sequence=m.sequence + 1, segments=segments, counts=counts, tombstones=dead, n_tombstones=number, batch=m.batch if batch is None else batch)

        out = self.log.advance(change)
        return self.compact() if len(out.segments) > SEGMENTS else out

    def _write_lost_terms(self, m: Manifest, passages: DataFrame, at: str) -> None:
        """The dictionary of all that is gone from the segments: what was, and these passages, with counts below zero."""
        lost = inverted.dictionary(inverted.placed(passages))
        counts = [c for c in lost.columns if c.startswith("df")]
        rows = lost.withColumns({c: -F.col(c) for c in counts})
        if m.tombstones:
            rows = rows.unionByName(self.spark.read.schema(inverted.TERMS).parquet(f"{self.base}/{m.tombstones}/terms"))
        rows.groupBy("bucket", "term").agg(*(F.sum(c).alias(c) for c in counts)).repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.parquet(at)

    def reconcile(self, root: str, root_id: str = "root", parser: Callable = extract.parse, complete: bool = True, batch: int | None = None, retry: bool = False) -> Manifest:
        """Bring the index in line with a scan of a root: new and changed files come in, missing ones go if the scan saw everything.

        Only the listing is read of what hasn't changed; with nothing changed nothing is published. Files are read again if
        their size or date differs, if a newer recipe extracts them, or, with `retry`, if their extraction failed. A scan
        that met errors, or of which the caller knows that it isn't complete, removes only what the policy excludes.
        """
        m = self.log.current()
        if not m.segments:
            return self.index(self.read_folder(root, root_id, parser), {root_id: discovery.plain_path(root)})
        stage = f"{self.base}/scan-{uuid4().hex}"
        try:
            skip = tuple(f.lower() for f in self.policy.folders)
            discovery.scan(self.spark, root, root_id, skip).write.parquet(stage)
            seen = self.spark.read.schema(discovery.SCANNED).parquet(stage)
            complete = complete and seen.filter("kind = 'error'").isEmpty()
            here = seen.filter((F.col("kind") == "file") & (F.col("availability") == "available") & ~self._left_out(root)).withColumn("modified_at", F.col("modified_at").cast("timestamp_ntz"))
            known = self._table("files", m).filter(F.col("root_id") == root_id)
            recipes = self.spark.createDataFrame(list(self.recipes.items()), "extension string, version int")
            todo = M.needs_extraction(here.select("source_id", "path", "size", "modified_at", "extension"), known, recipes).select("source_id", "path")
            if retry:
                failed = known.filter("availability = 'extractionFailed'").select("source_id")
                todo = todo.unionByName(here.join(failed, "source_id", "left_semi").select("source_id", "path")).distinct()
            kept = seen.filter("kind = 'file'")  # a placeholder is there, though it can't be read
            gone = M.reconcile(known, kept, complete, self._left_out(root)).select("source_id")
            paths = [r["path"] for r in todo.select("path").limit(NAMED + 1).collect()]
            if not paths and batch is None and gone.isEmpty():
                return m
            rows = None
            if len(paths) > NAMED:
                rows = self.read_folder(root, root_id, parser).join(todo.select("source_id"), "source_id", "left_semi")
            elif paths:
                rows = self.read_folder(root, root_id, parser, paths)
            return self.apply(rows, gone, batch)
        finally:
            remove(self.spark, stage)

    def purge(self) -> Manifest:
        """Take out what the policy of now excludes, without a scan."""
        m = self.log.current()
        return self.apply(None, self._table("files", m).filter(self._excluded(m)).select("source_id")) if m.segments else m

    def compact(self, keep: int = 2, words: bool = False) -> Manifest:
        """Merge all segments into one, without what is gone, and remove folders that the last `keep` generations don't name.

        With `words` an index that was built without gets them, and the statistics of them: made once, of what is left.
        """

        def change(m: Manifest) -> Manifest:
            name = f"segment-{uuid4().hex}"
            number, at = m.sequence + 1, f"{self.base}/{name}"
            self._table("files", m).drop("sequence").write.parquet(f"{at}/files")
            self._table("passages", m).drop("sequence").repartitionByRange("passage_id").sortWithinPartitions("passage_id").write.parquet(f"{at}/passages")
            worded = m.words or words
            counts = self._words(name) if worded else m.counts
            vectors = self._vectors(m)
            out = m.after(sequence=number, segments={name: number}, counts=counts, tombstones=None, n_tombstones=0, words=worded)
            if vectors is None:
                return out
            if m.embedded >= max(m.segments.values()):
                return replace(self._with_snapshot(out, vectors.withColumn("sequence", F.lit(number))), embedded=number)
            return replace(out, **NO_VECTORS)  # some passages of the merged segment have none yet: all are embedded again

        out = self.log.advance(change)
        self.clean(keep)
        return out

    def clean(self, keep: int = 2) -> None:
        """Remove generations but the last `keep`, and folders that none of these names; a search that began earlier fails."""
        named = set().union(*(m.folders() for m in self.log.trim(max(1, keep))))
        for f in listed(self.spark, self.base):
            if f.split("-")[0] in ("segment", "tombstones", "vectors", "cards") and f not in named:
                remove(self.spark, f"{self.base}/{f}")

    # --- vectors ---

    def _vectors(self, m: Manifest) -> DataFrame | None:
        """passage_id, source_id, sequence, embedding of all live vectors."""
        sets = [*([f"{m.snapshot}/vectors"] if m.snapshot else []), *m.deltas]
        if not sets:
            return None
        parts = [self.spark.read.parquet(f"{self.base}/{s}").select("passage_id", "source_id", "sequence", "embedding") for s in sets]
        return self._live(m, reduce(DataFrame.unionByName, parts))

    def _with_snapshot(self, m: Manifest, vectors: DataFrame) -> Manifest:
        """A manifest with the vectors as its snapshot."""
        name = f"vectors-{uuid4().hex}"
        n = quantised.write(vectors.select("passage_id", "source_id", "sequence", "embedding"), f"{self.base}/{name}", "passage_id")
        return replace(m, snapshot=name if n else None, deltas=(), n_snapshot=n)

    def embed(self, embed: Callable[[list[str]], list] | None = None, model: str = "") -> Manifest:
        """Vectors of all passages with text that have none yet; of all anew, if those there are of another model.

        They are added beside the snapshot; a new one is made where enough has changed.
        """

        def change(m: Manifest) -> Manifest:
            if m.model != model and (m.snapshot or m.deltas):
                m = replace(m, **NO_VECTORS, cards=None)
            elif m.segments and m.embedded >= max(m.segments.values()):
                return m
            name = f"vectors-{uuid4().hex}"
            p = self._table("passages", m).filter((F.length("body") > 0) & (F.col("sequence") > m.embedded))
            p.select("passage_id", "source_id", "sequence", embed_column(F.col("body"), embed).alias("embedding")).write.parquet(f"{self.base}/{name}")
            out = replace(m, deltas=(*m.deltas, name), embedded=m.sequence, model=model)
            live = self._vectors(out)
            counts = live.agg(F.count("*")).first()[0], sum(self.spark.read.parquet(f"{self.base}/{d}").count() for d in out.deltas)
            removed = max(0, m.n_snapshot + counts[1] - counts[0])
            facts = self.spark.range(1).select(V.rebuild_needed(F.lit(m.n_snapshot), F.lit(counts[1]), F.lit(removed))).first()[0]
            return (self._with_snapshot(out, live) if facts else out).after()

        return self.log.advance(change)

    def reset_embeddings(self) -> Manifest:
        """Forget all vectors; searches are text searches until `embed` has made new ones."""
        return self.log.advance(lambda m: m.after(**NO_VECTORS, cards=None, model=None) if m.snapshot or m.deltas or m.cards else m)

    def embed_cards(self, cards: DataFrame, embed: Callable[[list[str]], list] | None = None) -> Manifest:
        """The document lane: cards(source_id, text), one for a source, in place of what it had; with it, semantic searches fuse both lanes."""
        new = cards.select("source_id", embed_column(F.col("text"), embed).alias("embedding"))

        def change(m: Manifest) -> Manifest:
            name = f"cards-{uuid4().hex}"
            rows = M.upsert(self.spark.read.parquet(f"{self.base}/{m.cards}"), new, ["source_id"]) if m.cards else new
            rows.write.parquet(f"{self.base}/{name}")
            return m.after(cards=name)

        return self.log.advance(change)

    def ready(self) -> bool:
        m = self.log.current()
        return bool(m.snapshot or m.deltas)

    # --- searching ---

    def search(self, request: SearchRequest, embed: Callable[[list[str]], list] | None = None) -> DataFrame:
        """source_id, score, path, filename, extension, modified_at, snippet; best first."""
        m = self.log.current()
        mode = effective_mode(request.mode, bool(m.snapshot or m.deltas))
        query = parse(request.query) if mode != "semantic" and request.ranker == 1 else None
        words = query or (_worded(request.query) if mode != "semantic" else None)
        offset, depth = self._offset(request.cursor, m)
        most = max(request.limit + offset, depth)
        if mode == "text":
            hits = self._lexical(m, query, request, most)
        else:
            near = self._few(self._semantic(m, request, embed, most))
            hits = near if mode == "semantic" else self._hybrid(m, self._few(self._lexical(m, query, request, most)), near, request, most)
        first = [F.desc("exact")] if "exact" in hits.columns else []
        order = [*first, F.desc("score"), F.asc("source_id")]
        hits = hits.orderBy(*order).offset(offset).limit(request.limit)
        terms = [w for p in words.ranking for w in p] if words else []
        info = self._read_passages(m, hits)
        snippet = T.snippet(F.col("body"), terms) if terms else T.short_excerpt(F.col("body"))
        out = info.filter(~self._excluded(m)).orderBy(*order)
        out = out.select("source_id", "score", "path", "filename", "extension", "modified_at", snippet.alias("snippet"), T.with_utf16(T.highlights(snippet, terms), snippet).alias("highlights") if terms else F.array().alias("highlights"), *(["exact"] if first else []))
        return self._grouped(out, first) if request.group_copies else out.drop("exact")

    def _few(self, hits: DataFrame) -> DataFrame:
        """A list cut to its limit as rows at hand: what made it runs once, though it is used again and again."""
        return self.spark.createDataFrame(hits.collect(), hits.schema)

    def _grouped(self, out: DataFrame, first: list[Column]) -> DataFrame:
        """With the source that leads a group of near copies, and which copy of it a hit is. At most 200 rows."""
        placed = out.withColumn("position", F.row_number().over(Window.orderBy(*first, F.desc("score"), "source_id")))
        return M.near_duplicates(placed).drop("signature", "position", "exact")

    def _excluded(self, m: Manifest) -> Column:
        """Whether the policy of now leaves a hit's path out of its longest root."""
        root = F.lit(None).cast("string")
        for r in sorted(m.roots.values(), key=len):
            root = F.when(X.under(F.col("path"), r), F.lit(r)).otherwise(root)
        return F.coalesce(self.policy.excluded(F.col("path"), root) & root.isNotNull(), F.lit(False))

    def _read_passages(self, m: Manifest, hits: DataFrame) -> DataFrame:
        """hits(best_passage, ...) with their passages. Their numbers, 200 at most, go into the scan, whose row groups are sorted by them."""
        rows = hits.collect()
        found = self.spark.createDataFrame(rows, hits.schema)
        wanted = reduce(lambda a, b: a | b, (F.col("passage_id") == r["best_passage"] for r in rows), F.lit(False))
        info = self._table("passages", m).filter(wanted).select(F.col("passage_id").alias("best_passage"), "path", "filename", "extension", "modified_at", "body")
        return info.join(F.broadcast(found), "best_passage")

    def _lexical(self, m: Manifest, query, request: SearchRequest, limit: int) -> DataFrame:
        filtered = request.filters != X.Filters()
        if request.ranker == 2:
            where = request.filters.column_v2() if filtered else None
            return expression.search(self.index_of(m), self._table("passages", m), expression.parse(request.query), limit, 0, where)
        return inverted.search(self.index_of(m), query, limit, self._table("files", m) if filtered else None, request.filters.column() if filtered else None)

    def _semantic(self, m: Manifest, request: SearchRequest, embed, limit: int) -> DataFrame:
        vector = [float(x) for x in (embed or embed_texts)([request.query])[0]]
        k = max(limit, V.CANDIDATES_FILTERED if request.filters != X.Filters() else V.CANDIDATES)
        parts = []
        if m.deltas:
            new = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.base}/{d}").select("passage_id", "source_id", "sequence", "embedding") for d in m.deltas))
            parts.append(self._live(m, new).select("passage_id", "source_id", V.cosine_to(vector)("embedding").alias("score")))
        if m.snapshot:
            alive = (lambda rows: self._live(m, rows)) if m.tombstones else None
            parts.append(self._snapshot(m).search(vector, k, exact=request.exact, alive=alive, ties=("source_id",)).select("passage_id", "source_id", "score"))
        top = reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "source_id", "passage_id").limit(k).drop("source_id")  # a passage's number is a hash
        passages = self._table("passages", m)
        images = bool(request.filters.extensions & set(IMAGES))
        near = V.semantic_search(top, passages, request.filters.column(), images, limit).withColumnRenamed("passage_id", "best_passage")
        if not m.cards:
            return near
        cards = self.spark.read.parquet(f"{self.base}/{m.cards}").select("source_id", V.cosine_to(vector)("embedding").alias("score"))
        wanted = self._table("files", m).filter(request.filters.column()).select("source_id")
        lane = cards.join(wanted, "source_id", "left_semi").orderBy(F.desc("score"), "source_id").limit(limit)
        fused = V.fuse(V.positions(near), V.positions(lane), 0.5, limit).drop("exact")
        heads = passages.filter("ordinal = 0").select("source_id", F.col("passage_id").alias("_head")).join(F.broadcast(lane.select("source_id")), "source_id")
        best = fused.join(near.select("source_id", "best_passage"), "source_id", "left").join(heads, "source_id", "left")
        return best.select("source_id", "score", F.coalesce("best_passage", "_head").alias("best_passage"))

    def _snapshot(self, m: Manifest) -> quantised.Index:
        if m.snapshot not in self._snapshots:
            self._snapshots = {m.snapshot: quantised.Index(self.spark, f"{self.base}/{m.snapshot}")}
        return self._snapshots[m.snapshot]

    def _hybrid(self, m: Manifest, lexical: DataFrame, near: DataFrame, request: SearchRequest, limit: int) -> DataFrame:
        """Both lists fused by rank; hits whose name or text holds the query as it stands come first."""
        plain = request.query.strip().strip('"').lower()
        info = self._read_passages(m, lexical)
        first = V.positions(info.select("source_id", "score", "best_passage", F.concat_ws("\n", F.lower("filename"), F.lower("body")).alias("seen")))
        fused = V.fuse(first, V.positions(near), request.semantic_weight, limit, F.contains("seen", F.lit(plain)))
        best = lexical.select("source_id", F.col("best_passage").alias("a")).join(near.select("source_id", F.col("best_passage").alias("b")), "source_id", "full_outer")
        return fused.join(best, "source_id").select("source_id", "score", F.coalesce("a", "b").alias("best_passage"), "exact")

    def cursor(self, offset: int, depth: int = 0) -> str:
        """Where a page begins. Pages whose cursors name one depth, how many hits they reach in all, are parts of one list."""
        return f"{self.generation()}:{offset}:{depth}"

    def _offset(self, cursor: str | None, m: Manifest) -> tuple[int, int]:
        if not cursor:
            return 0, 0
        generation, offset, depth = [*cursor.split(":"), "0"][:3]
        if int(generation) != m.generation:
            raise StaleCursor("the index has changed; search again")
        return int(offset), int(depth)

    # --- history and saved searches ---

    def _kept(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def record(self, query: str) -> None:
        """Add a query to the history."""
        row = self.spark.createDataFrame([(query,)], "query string").select(F.unix_micros(F.current_timestamp()).alias("id"), "query", M.normalise_query(F.col("query")).alias("normalized_query"), F.current_timestamp().cast("timestamp_ntz").alias("searched_at"))
        row.coalesce(1).write.mode("append").parquet(f"{self.base}/history")

    def history(self, limit: int = 50) -> DataFrame:
        rows = self._kept("history", "id long, query string, normalized_query string, searched_at timestamp_ntz")
        return M.coalesce_history(rows).orderBy(F.desc("searched_at"), F.desc("id")).limit(limit)

    def clear_history(self) -> None:
        remove(self.spark, f"{self.base}/history")

    def save_search(self, name: str, request: SearchRequest, pinned: bool = False, deleted: bool = False) -> None:
        """Keep a search under a name; saving again replaces it."""
        body = json.dumps(asdict(request), default=sorted)
        row = self.spark.createDataFrame([(name, body, pinned, deleted)], "name string, request string, pinned boolean, deleted boolean")
        row.withColumn("saved_at", F.unix_micros(F.current_timestamp())).coalesce(1).write.mode("append").parquet(f"{self.base}/saved")

    def saved_searches(self) -> DataFrame:
        """Pinned ones first, then by name."""
        rows = self._kept("saved", "name string, request string, pinned boolean, deleted boolean, saved_at long")
        newest = M.latest(rows, ["name"], [F.desc("saved_at")]).filter("not deleted")
        return newest.orderBy(F.desc("pinned"), F.lower("name")).select("name", "request", "pinned")

    # --- reports ---

    def health(self) -> DataFrame:
        none = self.spark.createDataFrame([], "root_id string, discovery_error_count long")
        return M.health(self.files(), self.passages(), self.spark.createDataFrame([], "source_id string"), none)

    def issues(self, limit: int = 100) -> DataFrame:
        return M.issues(self.files(), limit)

    def dimensions(self) -> int:
        return DIMENSIONS
