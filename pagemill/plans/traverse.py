"""T1 page-chain traversal (follow next links from many seeds at once).

Pages with one next link each form paths, and all seeds walk them by path
doubling: a table holds, for every page, the page 2^k links on (its jump), and
for every seed the pages met in its first 2^k hops.  Round k joins both kinds of
rows with the jumps once: jumps grow to 2^(k+1) links, and what a seed met is met
again 2^k hops on.  A cap of ``max_pages`` takes log2(max_pages) rounds, however
long the chains are, and fewer if no seed meets a new page (a chain ended or
went round).

Every round is one written table in the folder of ``spark.checkpoint.dir``: the plan
does not grow, and a lost executor repeats the round it worked on at most.

Link tables with several next links on some pages (forks) are walked from fork to
fork, as jumps over forks would multiply.  Path doubling finds the stretch from every
seed and from every page that a fork links to up to the next fork; stretches give
arcs with lengths between these entries.  The entries that a seed reaches are then
found in rounds, one per fork on the shortest way at most, however many pages
lie between forks, and the stretches of the entries are the pages it meets.  A link
from a page to itself leads nowhere and makes no fork.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path


def _write_round(rows: DataFrame, **watched) -> tuple[DataFrame, dict, str]:
    """``rows`` written to a scratch folder and read back, what was observed on the way, and the folder."""
    spark = rows.sparkSession
    path, seen = scratch_path(spark, "hops"), Observation()
    if not watched:
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path), {}, path
    rows.observe(seen, *[c.alias(n) for n, c in watched.items()]).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), seen.get, path


def follow_next(links: DataFrame, seeds: DataFrame, max_pages: int) -> DataFrame:
    """``(seed, hop, url)``, hop 1 = the seed itself.

    ``links`` has ``(url, next_url)``; ``seeds`` has ``url``.  A chain stops
    when a page has no next link, when it would revisit a page of the same
    seed, or after ``max_pages`` pages.
    """
    if max_pages <= 0:
        raise ValueError("max_pages must be > 0")
    edges = (links.filter(F.col("next_url").isNotNull() & (F.col("next_url") != F.col("url"))).groupBy("url")
             .agg(F.min("next_url").alias("first"), F.max("next_url").alias("last")))
    jumps = edges.select(F.lit(True).alias("jump"), F.col("url").alias("origin"), F.col("first").alias("url"),
                         F.when(F.col("first") == F.col("last"), 0).otherwise(-1).cast("long").alias("hop"))  # -1: several links
    rows, seen, path = _write_round(jumps.unionByName(_starts(seeds)), branching=F.count_if(F.col("hop") < 0))
    if seen["branching"]:
        return _between_forks(links, seeds, max_pages, rows, path)
    return _stretches(rows, path, max_pages).select(F.col("origin").alias("seed"), F.col("hop").cast("int").alias("hop"), "url")


def _starts(pages: DataFrame) -> DataFrame:
    return pages.select(F.lit(False).alias("jump"), F.col("url").alias("origin"), "url").distinct().withColumn("hop", F.lit(1).cast("long"))


def _stretches(rows: DataFrame, path: str, max_pages: int) -> DataFrame:
    """Path doubling: ``(origin, url, hop)`` of the pages met from every start along single links."""
    step = 1
    while step < max_pages:
        here = rows.filter("jump").select(F.col("origin").alias("_from"), F.col("url").alias("_to"))
        # many rows may stand on one page but every page jumps once: the adaptive plan splits a hot page
        there = rows.filter(F.col("jump") | (F.col("hop") + step <= max_pages)).join(here, F.col("url") == F.col("_from")) \
            .select("jump", "origin", F.col("_to").alias("url"), F.when(F.col("jump"), 0).otherwise(F.col("hop") + step).alias("hop"))
        met = rows.filter("not jump").unionByName(there.filter("not jump")).groupBy("jump", "origin", "url").agg(F.min("hop").alias("hop"))
        rows, seen, done = _write_round(there.filter("jump").unionByName(met), new=F.count_if(~F.col("jump") & (F.col("hop") > step)))
        remove_path(rows.sparkSession, path)  # read by nothing but the round that is written now
        path, step = done, 2 * step
        if not seen["new"]:
            break
    return rows.filter("not jump").select("origin", "url", "hop")


def _between_forks(links: DataFrame, seeds: DataFrame, max_pages: int, rows: DataFrame, path: str) -> DataFrame:
    """T1 with forks: ``rows`` are the first round's, in the folder ``path``, in which forks have the hop -1."""
    spark = rows.sparkSession
    forks = rows.filter("jump and hop < 0").select(F.col("origin").alias("url"))
    exits, _, exits_path = _write_round(links.filter(F.col("next_url") != F.col("url")).join(forks, "url", "left_semi")
                                        .select(F.col("url").alias("fork"), F.col("next_url").alias("to")).distinct())
    single, _, single_path = _write_round(rows.filter("jump and hop = 0").unionByName(_starts(seeds.select("url").union(exits.select("to")))))
    remove_path(spark, path)
    stretches = _stretches(single, single_path, max_pages)
    # the entries that the last page of a stretch, a fork, links to: the hop of that page is the length of the way
    arcs, _, arcs_path = _write_round(
        stretches.join(exits, F.col("url") == F.col("fork")).filter(F.col("origin") != F.col("to"))
        .groupBy("origin", "to").agg(F.min("hop").alias("length")))
    remove_path(spark, exits_path)
    reached, seen, path = _write_round(_starts(seeds).select(F.col("origin").alias("seed"), F.col("url").alias("entry"), "hop", F.lit(True).alias("fresh")),
                                       fresh=F.count_if(F.col("fresh")))
    while seen["fresh"]:
        beyond = reached.filter("fresh").join(arcs, F.col("entry") == F.col("origin")) \
            .select("seed", F.col("to").alias("entry"), (F.col("hop") + F.col("length")).alias("hop"), F.lit(None).cast("long").alias("known")) \
            .filter(F.col("hop") <= max_pages)
        nearest = reached.select("seed", "entry", "hop", F.col("hop").alias("known")).unionByName(beyond) \
            .groupBy("seed", "entry").agg(F.min("hop").alias("hop"), F.min("known").alias("known"))
        reached, seen, done = _write_round(nearest.select("seed", "entry", "hop", (F.col("known").isNull() | (F.col("hop") < F.col("known"))).alias("fresh")),
                                           fresh=F.count_if(F.col("fresh")))
        remove_path(spark, path)
        path = done
    remove_path(spark, arcs_path)
    met = reached.select("seed", "entry", F.col("hop").alias("_at")).join(stretches, F.col("entry").eqNullSafe(F.col("origin"))) \
        .select("seed", "url", (F.col("_at") + F.col("hop") - 1).alias("hop")).filter(F.col("hop") <= max_pages)
    return met.groupBy("seed", "url").agg(F.min("hop").alias("hop")).select("seed", F.col("hop").cast("int").alias("hop"), "url")


def chain_page_count(next_links: DataFrame, visited: DataFrame) -> DataFrame:
    """Per seed, the reference's ``page_count`` (next links seen on
    visited pages) next to the number of pages visited."""
    seen = visited.join(next_links.select("url").withColumn("_one", F.lit(1)), "url", "left")
    return seen.groupBy("seed").agg(F.count("_one").alias("page_count"),
                                    F.countDistinct("url").alias("pages_visited"))
