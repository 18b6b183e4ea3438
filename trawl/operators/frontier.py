"""URL sets and breadth-first discovery.

The reference keeps ``discovered`` and ``processed`` as in-memory sets and
walks the link graph breadth first.  Here both sets are DataFrames; one
round of the walk is a join of the frontier with the edge table (C8), the
same-domain filter (B7), a ``distinct`` and an anti join with what is
already discovered (C3).  The loop runs ``max_depth`` rounds or until nothing is new; each
round's new URLs are written as a parquet table into the shared
``spark.checkpoint.dir`` and read back, which cuts the lineage, so a lost
executor costs at most one round, not the whole walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.urls import authority, is_same_domain, normalize_url
from trawl.session import checkpoint_dir, materialize
from trawl.sources.versions import BucketedTable, Versions


def url_set(df: DataFrame, col: str = "url") -> DataFrame:
    """A one-column distinct URL set."""
    return df.select(F.col(col).alias("url")).where(F.col("url").isNotNull()).distinct()


def union_urls(*sets: DataFrame) -> DataFrame:
    """G1: union of URL sets (set semantics)."""
    out = sets[0].select("url")
    for s in sets[1:]:
        out = out.unionByName(s.select("url"))
    return out.distinct()


def mark_processed(processed: DataFrame, urls: DataFrame) -> DataFrame:
    """Processed ∪ urls."""
    return union_urls(processed, urls)


def pending_urls(discovered: DataFrame, processed: DataFrame) -> DataFrame:
    """Discovered − processed."""
    return discovered.select("url").distinct().join(processed.select("url"), "url", "left_anti")


def discover(edges: DataFrame, seeds: DataFrame, base: str | None = None, max_depth: int | None = 3,
             pages: DataFrame | None = None, src="src", dst="dst") -> DataFrame:
    """Breadth-first discovery from ``seeds`` over ``edges``.

    ``seeds``: one column ``url`` (sitemap URLs and the base URL, already
    normalised).  ``base``: the domain whose pages are followed (sub-domains
    included); None follows every target.  ``pages``: URLs that can be
    fetched (default: every ``src`` of ``edges``); a frontier URL outside it
    is an error node and is not processed.

    ``max_depth`` None follows links until nothing new is found.

    Each round joins the frontier with the edge table, and its distinct targets
    with what is discovered.  All sides are written tables, so Spark knows their
    size on disk: it broadcasts a side under ``spark.sql.autoBroadcastJoinThreshold``
    (the edges are then scanned in place) and shuffles both otherwise.

    Returns ``(url, depth, processed, error)``: depth of first discovery;
    URLs found in the last round are discovered but pending.
    """
    checkpoint_dir(edges.sparkSession)
    # duplicates are harmless (each round's targets are de-duplicated), so the edge table is
    # written as it comes, without a shuffle; sorted pieces let a round skip row groups
    e = materialize(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
                    .where(F.col("dst").isNotNull()).sortWithinPartitions("src"), "bfs-edges")
    if pages is not None:
        fetchable = materialize(url_set(pages), "bfs-pages")
    else:   # every source of an edge is a page; a URL without out-edges finds nothing
        fetchable = None

    disc = frontier = materialize(url_set(seeds).withColumn("depth", F.lit(0)), "bfs-depth0")
    depth = 0
    while max_depth is None or depth < max_depth:
        fr = frontier.select("url")
        if fetchable is not None:
            fr = fr.join(fetchable, "url", "left_semi")
        cand = e.join(fr, e["src"] == fr["url"]).groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("_n"))
        if base is not None:       # B7 on each distinct target once; with the count in it, no optimizer moves it to every edge
            cand = cand.where(F.when(F.col("_n") > 0, is_same_domain("url", F.lit(base))))
        cand = cand.select("url")
        new = cand.join(disc.select("url"), "url", "left_anti")
        frontier = materialize(new.withColumn("depth", F.lit(depth + 1)), f"bfs-depth{depth + 1}")
        depth += 1
        if frontier.isEmpty():
            break
        disc = disc.unionByName(frontier)   # union of written pieces: short lineage
    rounds = depth
    if fetchable is None:
        # only sources among the discovered URLs
        fetchable = e.select(F.col("src").alias("url")).join(disc.select("url"), "url", "left_semi").distinct()
    is_page = fetchable.withColumn("_ok", F.lit(True))
    return (disc.join(is_page, "url", "left")
            .select("url", "depth",
                    (F.col("_ok").isNotNull() & (F.col("depth") < rounds)).alias("processed"),
                    F.when(F.col("_ok").isNull() & (F.col("depth") < rounds),
                           F.lit("not fetchable")).alias("error")))


class Walk:
    """A breadth-first walk that is kept (G6, C8): stopped after any round, or by a crash, it goes on where it was.

    * The edges lie in buckets of their source's hash (:func:`bucketed_edges`).  A round reads only the buckets that hold
      a URL of its frontier, so what it reads falls with the frontier.
    * The state is a table in versions: each committed version adds one round's new URLs as a piece.  The discovered
      set is the union of the pieces, and the last piece is the frontier; nothing lives in memory between rounds.

    URLs whose links were followed are processed and never followed again: later seeds (:meth:`add`) and later runs see
    what earlier ones discovered.
    """

    def __init__(self, edges: BucketedTable, path: str, base: str | None = None, pages: DataFrame | None = None):
        self.spark, self.edges, self.base, self.pages = edges.spark, edges, base, pages
        checkpoint_dir(self.spark)
        self.state = Versions(self.spark, path)

    def _pieces(self) -> list[tuple[int, str, str]]:
        """(number, kind, folder) of the pieces, oldest first."""
        return sorted((int(p), note, folder) for p, (folder, note) in self.state.manifest().items())

    def _table(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], "url string, depth int")
        return self.spark.read.schema("url string, depth int").parquet(*[self.state.at(f) for f in folders])

    def discovered(self) -> DataFrame:
        """(url, depth) of everything found so far."""
        return self._table([f for _, _, f in self._pieces()])

    def frontier(self) -> DataFrame:
        """The URLs whose links have not been looked at."""
        return self._table([f for _, kind, f in self._pieces() if kind == "open"])

    def _commit(self, new: DataFrame, done: bool) -> bool:
        """Add ``new`` as the open piece; with ``done`` the open pieces before it are followed.  True if it holds URLs."""
        version = self.state.latest()
        pieces = self.state.manifest(version) if version is not None else {}
        if done:
            pieces = {p: (f, "followed") for p, (f, _) in pieces.items()}
        folder = self.state.new_folder("found")
        new.write.parquet(self.state.at(folder))
        found = not self._table([folder]).isEmpty()
        if found:
            pieces[str(len(pieces))] = (folder, "open")
        if found or done:
            self.state.commit(0 if version is None else version + 1, pieces)
        return found

    def add(self, seeds: DataFrame) -> bool:
        """Seeds that are not discovered yet join the frontier at depth 0."""
        new = url_set(seeds).join(self.discovered().select("url"), "url", "left_anti")
        return self._commit(new.withColumn("depth", F.lit(0)), done=False)

    def step(self) -> bool:
        """One round: follow the frontier's links.  False when nothing new was found."""
        frontier = self.frontier()
        fr = frontier.select(F.col("url").alias("src"), "depth")
        if self.pages is not None:
            fr = fr.join(url_set(self.pages).select(F.col("url").alias("src")), "src", "left_semi")
        fr = materialize(fr, "walk-frontier")
        hit = self.edges.buckets_of(fr)
        cand = self.edges.read(hit).join(fr, "src").groupBy(F.col("dst").alias("url")).agg((F.min("depth") + 1).alias("depth"))
        if self.base is not None:
            cand = cand.where(F.when(F.col("depth") >= 0, is_same_domain("url", F.lit(self.base))))     # once a target
        return self._commit(cand.join(self.discovered().select("url"), "url", "left_anti"), done=True)

    def run(self, rounds: int | None = None) -> int:
        """Up to ``rounds`` rounds (None: until nothing is new); returns how many found something."""
        n = 0
        while (rounds is None or n < rounds) and not self.frontier().isEmpty():
            if not self.step():
                break
            n += 1
        return n

    def result(self) -> DataFrame:
        """``(url, depth, processed, error)`` as from :func:`discover`."""
        followed = self._table([f for _, kind, f in self._pieces() if kind == "followed"]).withColumn("_followed", F.lit(True))
        found = followed.unionByName(self.frontier().withColumn("_followed", F.lit(False)))
        if self.pages is None:
            pages = self.edges.read().select(F.col("src").alias("url")).join(found.select("url"), "url", "left_semi").distinct()
        else:
            pages = url_set(self.pages)
        out = found.join(pages.withColumn("_ok", F.lit(True)), "url", "left")
        return out.select("url", "depth", (F.col("_followed") & F.col("_ok").isNotNull()).alias("processed"),
                          F.when(F.col("_followed") & F.col("_ok").isNull(), F.lit("not fetchable")).alias("error"))


def bucketed_edges(edges: DataFrame, path: str, buckets: int = 64, src: str = "src", dst: str = "dst") -> BucketedTable:
    """Write an edge table by buckets of the source's hash, for any number of walks."""
    table = BucketedTable(edges.sparkSession, path)
    table.create(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where(F.col("dst").isNotNull()), "src", buckets)
    return table


def discover_from(edges: DataFrame, base_url: str, sitemap_urls: DataFrame | None = None,
                  max_depth: int = 3, **kw) -> DataFrame:
    """G6 with the reference's seeding: normalised base URL ∪ sitemap URLs;
    only links inside the base URL's domain are followed."""
    spark = edges.sparkSession
    base = spark.createDataFrame([(base_url,)], "url string").select(normalize_url("url").alias("url"))
    seeds = base if sitemap_urls is None else union_urls(base, sitemap_urls.select(normalize_url("url").alias("url")))
    domain = base.select(authority("url").alias("d")).first()["d"]
    return discover(edges, seeds, domain, max_depth, **kw)


def url_stats(discovered: DataFrame, processed: DataFrame | None = None,
              start=None, end=None) -> DataFrame:
    """Discovered, processed, pending, distinct authorities, elapsed
    seconds and URLs/s (0 when elapsed <= 0; both NULL unless both times
    are known).  ``discovered`` may carry a ``processed`` flag (as from
    :func:`discover`); otherwise pass the processed set."""
    d = discovered.select("url", *(["processed"] if "processed" in discovered.columns else []))
    if processed is not None:
        flag = processed.select("url").distinct().withColumn("processed", F.lit(True))
        d = d.select("url").distinct().join(flag, "url", "left")
    d = d.withColumn("processed", F.coalesce(F.col("processed"), F.lit(False)))
    agg = d.agg(F.count("*").alias("total_discovered"),
                F.count_if("processed").alias("total_processed"),
                F.count_if(~F.col("processed")).alias("pending"),
                F.count_distinct(authority("url")).alias("domains"))
    if start is not None and end is not None:
        el = (F.unix_micros(F.lit(end).cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))) / 1e6
        agg = agg.withColumn("elapsed_seconds", el).withColumn(
            "urls_per_second", F.when(el > 0, F.col("total_discovered") / el).otherwise(F.lit(0.0)))
    else:
        agg = agg.withColumn("elapsed_seconds", F.lit(None).cast("double")) \
                 .withColumn("urls_per_second", F.lit(None).cast("double"))
    return agg


def fetch_stats(fetch_log: DataFrame, duration_col: str = "duration", outcome_col: str = "outcome") -> DataFrame:
    """Requests, average fetch time (0 when there are none), errors and
    timeouts over a fetch log ``(url, duration, outcome)``."""
    n = F.count("*")
    return fetch_log.agg(
        n.alias("total_requests"),
        F.coalesce(F.avg(duration_col), F.lit(0.0)).alias("avg_fetch_time"),
        F.count_if(F.col(outcome_col) == "error").alias("errors"),
        F.count_if(F.col(outcome_col) == "timeout").alias("timeouts"))
