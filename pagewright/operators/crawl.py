"""The crawl frontier over a table of links, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.plans.session import cut_lineage

#: Keys let in at once up to which they are broadcast (some 100 bytes each).
BROADCAST_PAGES = 100_000


def enqueue(offered: DataFrame, seen: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """Rows (seq, key, depth, in_scope) of one level with the status each gets.

    Checks in order: invalid_url, depth_exceeded, duplicate (of ``seen`` or of an
    earlier offer that was let in), page_limit_reached, out_of_scope.  The limit
    counts the URLs that are seen.  An offer out of scope never becomes seen, so
    it reads page_limit_reached only after the limit is reached.
    """
    known = seen.select("key").distinct().withColumn("_known", F.lit(True))
    size = seen.agg(F.count("*").alias("_size"))
    rows = offered.join(known, "key", "left").join(F.broadcast(size))
    fresh = F.col("key").isNotNull() & F.col("_known").isNull() & (F.col("depth") <= max_depth) & F.col("in_scope")
    # the first offer of each key that may be let in; only the first max_pages of these keys matter, so the global order is of them alone
    firsts = rows.where(fresh).groupBy("key").agg(F.min("seq").alias("seq"))
    ranked = firsts.orderBy("seq").limit(max_pages).withColumn("_place", F.row_number().over(Window.orderBy("seq")))
    places = ranked.select("key", F.col("seq").alias("_seq"), "_place")
    placed = rows.join(F.broadcast(places) if max_pages <= BROADCAST_PAGES else places, "key", "left")
    room = F.lit(max_pages) - F.col("_size")
    let_in = (F.col("_place") <= room) & (F.col("seq") == F.col("_seq"))
    filled = ranked.join(F.broadcast(size)).where(F.col("_place") == F.lit(max_pages) - F.col("_size")).agg(F.min("seq").alias("_filled"))
    full = placed.join(F.broadcast(filled))
    at_limit = (room <= 0) | (F.col("seq") > F.col("_filled"))
    earlier = F.col("_known").isNotNull() | ((F.col("_place") <= room) & (F.col("seq") > F.col("_seq")))
    status = (
        F.when(F.col("key").isNull(), "invalid_url")
        .when(F.col("depth") > max_depth, "depth_exceeded")
        .when(earlier, "duplicate")
        .when(F.coalesce(at_limit, F.lit(False)), "page_limit_reached")
        .when(~F.col("in_scope"), "out_of_scope")
        .when(let_in, "enqueued")
        .otherwise("page_limit_reached")
    )
    return full.select(*offered.columns, status.alias("status"))


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int = 50) -> DataFrame:
    """Rows (key, depth) of a breadth-first crawl over links (source, target, seq, in_scope).

    Within a level, offers come in the order of their source and seq.  Each level
    is written to the shared folder.
    """
    seen = cut_lineage(seeds.select("key").distinct().withColumn("depth", F.lit(0)).orderBy("key").limit(max_pages))
    for depth in range(1, max_depth + 1):
        level = seen.where(F.col("depth") == depth - 1)
        offers = level.join(links, level["key"] == links["source"]).select(F.struct("source", "seq").alias("seq"), F.col("target").alias("key"), F.lit(depth).alias("depth"), "in_scope")
        new = enqueue(offers, seen, max_depth, max_pages).where("status = 'enqueued'").select("key", "depth")
        longer = cut_lineage(seen.unionByName(new))
        if longer.where(F.col("depth") == depth).isEmpty():
            break
        seen = longer
    return seen


#: Attempts after the first, and failed pages after which a run stops.
MOST_RETRIES, MOST_FAILURES = 3, 50
#: What becomes of a page: only a loaded one offers its links.
LOADED, FAILED, FATAL, QUEUED, RETRYABLE = "loaded", "failed", "fatal", "queued", "retryable"


def outcomes(attempts: DataFrame, max_retries: int = MOST_RETRIES) -> DataFrame:
    """Rows (key, status, attempts): what becomes of each page after its retries.

    ``attempts`` has (key, attempt, outcome), numbered from 0 without gaps.  A
    retryable outcome is tried again up to ``max_retries`` times, then the page has
    failed; after the last attempt that is known, a page loads.
    """
    tried = attempts.where(F.col("attempt") <= max_retries)
    final = F.col("outcome") != RETRYABLE
    found = tried.groupBy("key").agg(F.min(F.when(final, F.col("attempt"))).alias("at"), F.min_by(F.when(final, F.col("outcome")), F.when(final, F.col("attempt"))).alias("outcome"), F.count("*").alias("n"))
    spent = F.col("n") > max_retries
    status = F.coalesce("outcome", F.when(spent, FAILED).otherwise(LOADED))
    return found.select("key", status.alias("status"), F.when(F.col("at").isNotNull(), F.col("at") + 1).when(spent, max_retries + 1).otherwise(F.col("n") + 1).cast("int").alias("attempts"))


def crawl_run(links: DataFrame, seeds: DataFrame, attempts: DataFrame, max_depth: int = 2, max_pages: int = 50, max_failures: int = MOST_FAILURES, max_retries: int = MOST_RETRIES) -> DataFrame:
    """Rows (key, depth, place, status, attempts) of a breadth-first run whose pages may fail.

    Pages are taken in the order in which they were let in (``place``, from 1).
    Only a loaded page offers its links.  A run stops at the page with which
    ``max_failures`` pages have failed, or at a fatal one; pages behind it stay
    queued, with no attempts, as do pages that loaded ones before it have offered.
    Within a level the failures so far are a running sum over pages in order, of
    which there are ``max_pages`` at most, whatever the number of links.
    """
    told = outcomes(attempts, max_retries)
    order = Window.orderBy("place")
    first = seeds.select("key").distinct().orderBy("key").limit(max_pages)
    waiting = cut_lineage(first.select("key", F.lit(0).alias("depth"), F.row_number().over(Window.orderBy("key")).alias("place")))
    done, failed, stopped = None, 0, False
    for depth in range(max_depth + 1):
        level = waiting.join(told, "key", "left").withColumns({"status": F.coalesce("status", F.lit(LOADED)), "attempts": F.coalesce("attempts", F.lit(1))})
        so_far = level.withColumn("failed", F.lit(failed) + F.count_if(F.col("status") == FAILED).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        last = (F.col("status") == FATAL) | ((F.col("status") == FAILED) & (F.col("failed") >= max_failures))
        behind = F.lit(stopped) | (F.coalesce(F.max(last.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
        taken = so_far.withColumn("behind", behind).select("key", "depth", "place", F.when(F.col("behind"), QUEUED).otherwise(F.col("status")).alias("status"), F.when(F.col("behind"), 0).otherwise(F.col("attempts")).alias("attempts"), "failed", (last & ~F.col("behind")).alias("last"))
        now = cut_lineage(taken)
        done = now if done is None else cut_lineage(done.unionByName(now))
        told_now = now.agg(F.max(F.when(F.col("status") != QUEUED, F.col("failed"))), F.max("last"), F.count("*")).first()
        failed, stopped = told_now[0] or failed, stopped or bool(told_now[1])
        if depth == max_depth or not told_now[2]:
            break
        loaded = now.where(F.col("status") == LOADED)
        offers = loaded.join(links, loaded["key"] == links["source"]).select(F.struct("place", "seq").alias("seq"), F.col("target").alias("key"), F.lit(depth + 1).alias("depth"), "in_scope")
        new = enqueue(offers, done, max_depth, max_pages).where("status = 'enqueued'")
        size = done.count()
        waiting = cut_lineage(new.select("key", "depth", (F.row_number().over(Window.orderBy("seq")) + size).alias("place")))
    return done.select("key", "depth", "place", "status", "attempts")


def run_result(pages: DataFrame, max_failures: int = MOST_FAILURES) -> DataFrame:
    """One row for a run: its status, and pages discovered, scanned, loaded and failed, with the retries that were made."""
    count = lambda c: F.count_if(c)
    status = F.col("status")
    sums = pages.agg(F.count("*").alias("discovered"), count(status != QUEUED).alias("scanned"), count(status == LOADED).alias("loaded"), count(status == FAILED).alias("failed"), count(status == FATAL).alias("fatal"), F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).alias("retries"))
    ended = F.when((F.col("fatal") > 0) | (F.col("failed") >= max_failures), "failed").otherwise("completed")
    return sums.select(ended.alias("status"), "discovered", "scanned", "loaded", "failed", "retries")
