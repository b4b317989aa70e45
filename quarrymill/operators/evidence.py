"""Rules that records of evidence files must keep, as predicates over tables: each gives the rows that break a rule, with its name."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import checks
from quarrymill.operators.ingest import MOST_PAGE_ITEMS, MOST_PAGES, MOST_QUERIES, MOST_TARGET

# Bounds of the records of a query set and of judgements.
FEWEST_SET, MOST_SET, MOST_SEEDS, MOST_RATIONALE = 20, 30, 5, 500
CATEGORY = r"^[a-z][a-z0-9_]{1,49}$"


def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `problems`, the names of the rules a row breaks, of the rows that break any. A rule that is null is broken."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("problems", found).where(F.size("problems") > 0)


def _line(c: str, low: int, high: int) -> Column:
    """Trimmed text on one line with a number of characters."""
    return (F.trim(F.col(c)) == F.col(c)) & ~F.col(c).rlike(r"[\r\n\x00]") & F.length(c).between(low, high)


def page_problems(pages: DataFrame) -> DataFrame:
    """pages: query, page_number, item_count, accepted_item_count, total_count, first_result, last_result."""
    bounds = F.col("first_result").isNotNull() & F.col("last_result").isNotNull()
    nothing = F.col("first_result").isNull() & F.col("last_result").isNull()
    return broken(pages, {
        "page_number": F.col("page_number").between(1, MOST_PAGES), "item_count": F.col("item_count").between(0, MOST_PAGE_ITEMS), "accepted_over_items": F.col("accepted_item_count").between(0, F.col("item_count")),
        "items_over_total": F.col("total_count") >= F.col("item_count"), "boundaries": F.when(F.col("item_count") > 0, bounds).otherwise(nothing),
    })


def page_gaps(pages: DataFrame) -> DataFrame:
    """(query, pages, last_page) of queries whose page numbers are not 1, 2, 3 ..."""
    seen = pages.groupBy("query").agg(F.count("*").alias("pages"), F.count_distinct("page_number").alias("_d"), F.min("page_number").alias("_low"), F.max("page_number").alias("last_page"))
    return seen.where("_low <> 1 OR _d <> pages OR last_page <> pages").drop("_d", "_low")


def header_problems(header: dict) -> list[str]:
    """What is wrong with the header of a manifest: generated_at, seed_repositories, queries, target_skills, target_reached, candidate_count."""
    out = []
    try:
        if datetime.fromisoformat(str(header.get("generated_at")).replace("Z", "+00:00")).tzinfo is None:
            out.append("generated_at_without_zone")
    except ValueError:
        out.append("generated_at_without_zone")
    seeds = list(header.get("seed_repositories") or ())
    spelled = {s.strip().lower() for s in seeds}
    if not seeds or seeds != sorted(seeds, key=str.lower) or len(spelled) != len(seeds) or any(s != s.strip() or not s for s in seeds):
        out.append("seeds_not_normalised")
    queries = list(header.get("queries") or ())
    if not 1 <= len(queries) <= MOST_QUERIES or len(set(queries)) != len(queries) or any(not q or q != q.strip() for q in queries):
        out.append("queries_not_unique_and_trimmed")
    target, count = header.get("target_skills"), header.get("candidate_count")
    if not isinstance(target, int) or not 1 <= target <= MOST_TARGET:
        out.append("target_out_of_range")
    elif (count == target) != bool(header.get("target_reached")) or count > target:
        out.append("target_reached_disagrees")
    return out


def discovery_bounds(queries: int, target: int, per_page: int, pages: int) -> None:
    """Raises if the inputs of a discovery are out of their bounds."""
    for name, value, most in (("queries", queries, MOST_QUERIES), ("target", target, MOST_TARGET), ("per_page", per_page, MOST_PAGE_ITEMS), ("pages", pages, MOST_PAGES)):
        if not 1 <= value <= most:
            raise checks.ContractError(f"{name} must be between 1 and {most}")


def query_problems(queries: DataFrame) -> DataFrame:
    """queries: query_id, query_text, category, split, intent, pool_seed_document_ids."""
    seeds = F.col("pool_seed_document_ids")
    return broken(queries, {
        "query_id": F.col("query_id").rlike(r"^q[0-9]{3}$"), "query_text": _line("query_text", 3, 200), "intent": _line("intent", 10, 500), "category": F.col("category").rlike(CATEGORY),
        "split": F.col("split").isin("development", "test"), "seed_count": F.size(seeds).between(1, MOST_SEEDS), "seeds_unique": F.size(F.array_distinct(seeds)) == F.size(seeds),
        "seed_ids": F.forall(seeds, lambda d: checks.document_id(d)),
    })


def split_counts(queries: DataFrame) -> DataFrame:
    """One row: query_count, development_count, test_count."""
    return queries.agg(F.count("*").alias("query_count"), F.count_if(F.col("split") == "development").alias("development_count"), F.count_if(F.col("split") == "test").alias("test_count"))


def require_query_set(queries: DataFrame) -> dict:
    """The header's counts of a query set of 20 to 30 queries with both splits, or an error."""
    counts = split_counts(queries).first().asDict()
    if not FEWEST_SET <= counts["query_count"] <= MOST_SET or min(counts["development_count"], counts["test_count"]) < 1:
        raise checks.ContractError("a query set has 20 to 30 queries in two splits")
    checks.require_none(query_problems(queries).select("query_id", "problems"), "queries break the rules of their records")
    return counts


def qrel_counts(qrels: DataFrame) -> DataFrame:
    """One row: query_count (distinct), judgement_count, relevant_judgement_count."""
    return qrels.agg(F.count_distinct("query_id").alias("query_count"), F.count("*").alias("judgement_count"), F.count_if(F.col("relevance") >= 1).alias("relevant_judgement_count"))


def qrel_problems(qrels: DataFrame) -> DataFrame:
    """qrels: query_id, document_id, content_sha256, relevance, rationale (null or trimmed text)."""
    why = F.col("rationale")
    return broken(qrels, {
        "document_id": checks.document_id(F.col("document_id")), "content_sha256": F.col("content_sha256").rlike("^[0-9a-f]{64}$"), "relevance": F.col("relevance").between(0, 2),
        "rationale": why.isNull() | (F.trim(why) == why) & F.length(why).between(1, MOST_RATIONALE),
    })


def pool_problems(pool: DataFrame) -> DataFrame:
    """pool: query_id, document_id, sources, bm25_rank. Sources are unique, bm25 before query_seed; a rank goes with the source bm25."""
    s = F.col("sources")
    return broken(pool, {
        "sources": (F.size(s) >= 1) & F.forall(s, lambda x: x.isin("bm25", "query_seed")) & (F.array_sort(F.array_distinct(s)) == s),
        "bm25_rank": F.array_contains(s, "bm25") == F.col("bm25_rank").isNotNull(), "rank_range": F.coalesce("bm25_rank", F.lit(1)) >= 1, "document_id": checks.document_id(F.col("document_id")),
    })
