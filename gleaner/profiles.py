"""Site profiles: the rules by which a documentation site's pages are read.

New sites register a profile; the register becomes a small table that joins on ``site``.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.functions import notes as N
from gleaner.functions import urls as U

# The register is code, not data: one row per site somebody wrote a profile for.
MAX_SITES = 10_000


@dataclass(frozen=True)
class SiteProfile:
    site: str
    label: str
    base_url: str
    markdown: str = "docs_page"  # a Markdown profile of the docs family, or "mdx" for component Markdown
    titles: tuple = ("og", "h1", "raw_title")  # sources of a page's title, in order
    drop_html: bool = False
    english_only: bool = False
    min_text: int = V.MIN_DOC
    tag_clouds: bool = False
    tags: list = field(default_factory=lambda: ["clippings", "documentation"])


SITES: dict[str, SiteProfile] = {}


def register_site(profile: SiteProfile) -> SiteProfile:
    SITES[profile.site] = profile
    return profile


# --- fixed values: documentation sites known from the start ---
register_site(SiteProfile(
    "snowflake", "Snowflake", "https://docs.snowflake.com", titles=("og", "raw_title")))
register_site(SiteProfile("soda", "Soda", "https://docs.soda.io", markdown="book_docs"))
register_site(SiteProfile(
    "aws", "AWS", "https://docs.aws.amazon.com", markdown="cloud_docs",
    titles=("topic", "og", "raw_title"), drop_html=True, english_only=True))
register_site(SiteProfile(
    "databricks", "Databricks Docs", "https://docs.databricks.com", markdown="theme_docs",
    titles=("h1", "og", "before_pipe"), tag_clouds=True))
register_site(SiteProfile("claude-code", "Claude Code Docs", "https://code.claude.com/docs", markdown="mdx"))


def profile_table(spark: SparkSession) -> DataFrame:
    rows = [{**asdict(p), "titles": list(p.titles)} for p in SITES.values()]
    schema = (
        "site string, label string, base_url string, markdown string, titles array<string>, drop_html boolean, "
        "english_only boolean, min_text int, tag_clouds boolean, tags array<string>")
    return spark.createDataFrame(rows, schema)


def with_rules(pages: DataFrame) -> DataFrame:
    """Pages with their site's rules; pages of unknown sites stay, their rules are null.

    The register is broadcast after a check of its size.
    """
    rules = profile_table(pages.sparkSession)
    return pages.join(F.broadcast(rules) if len(SITES) <= MAX_SITES else rules, "site", "left")


def doc_entries(pages: DataFrame) -> DataFrame:
    """``pages(site, url)`` as entries by their site's rules: slug, parent, note path, tags.

    A site without rules has no note paths; ``read_docs`` reports its pages.
    """
    joined = with_rules(pages).filter("label IS NOT NULL").filter(~F.col("english_only") | ~U.is_localized("url"))
    slug = F.when(F.col("drop_html"), U.slug_path("url", drop_html=True)).otherwise(U.slug_path("url"))
    cloud = F.when(F.col("tag_clouds"), U.cloud_tag("slug"))
    return joined.withColumn("slug", slug).select(
        *pages.columns, "slug", U.parent_path("slug").alias("parent_path"),
        N.doc_path(F.col("label"), F.col("slug")).alias("path"),
        F.array_compact(F.concat("tags", F.array("site", cloud))).alias("tags"))
