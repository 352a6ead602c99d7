"""Operator 4: URL filters by propagation over the host graph.

``judge`` gives each page the verdict of the longest rule that fits its URL. A rule is (verdict, host and path),
as in ("block", "example.org/es/"); it fits its host and all subdomains, if the URL's path starts with its path.
Rules are a table, however long: each URL is joined by the ends of its host and, for the lengths that rules of such a host
have, the starts of its path. Of equally long rules that fit the first counts; of equal rules likewise.

Pages that no rule fits get the verdict of their host. The rules' verdicts are the seeds: a host is trusted
and blocked by the shares of its pages that rules allow and block. Over the edges between hosts (links in the
pages' html, each two hosts once), trust flows along links by personalised PageRank, and distrust flows
against them: hosts that link to blocked ones lose. A host is blocked if its distrust is more than
``threshold`` times its trust. Each round is a join and an aggregation by host; hubs are pre-aggregated before the
shuffle and skewed joins are split by Spark.

Null URLs and those without "://": host and path are empty; no rule fits, and rows of the empty host are
allowed. Null html has no links. Hosts without seeds or links are allowed. Repeated rows count as pages of
their own. An empty table gives no rows. Further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import save

#: The parts of a URL, and links with a host.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'<>\s]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Rounds between two tables that cut the lineage.
KEPT = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def rules_table(spark: SparkSession, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(host, path, rule, verdict, nth), each host and path once. rules: pairs of verdict and rule, or a table of such columns
    (and nth, if their order matters)."""
    if isinstance(rules, DataFrame):
        rows = rules.select("verdict", "rule", F.col("nth").cast("long") if "nth" in rules.columns else F.monotonically_increasing_id().alias("nth"))
    else:
        rows = spark.createDataFrame([(v, r, i) for i, (v, r) in enumerate(rules)], "verdict string, rule string, nth long")
    host = F.substring_index("rule", "/", 1)
    rows = rows.select(host.alias("host"), F.substring(F.col("rule"), F.length(host) + 1, F.length("rule")).alias("path"), "rule", "verdict", "nth")
    return rows.groupBy("host", "path").agg(F.min(F.struct("nth", "rule", "verdict")).alias("r")).select("host", "path", "r.rule", "r.verdict", "r.nth")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: (host, path). (host, path, rule, verdict) of those that a rule fits, each once."""
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    labels = F.split("host", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = urls.where("host <> ''").distinct().select("host", "path", F.explode(ends).alias("end"))
    # few hosts have rules, so most ends go here; a rule may only be as long as the path
    known = known.join(lengths.withColumnRenamed("host", "end"), "end").select("host", "path", "end", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    known = known.withColumn("start", F.substring(F.col("path"), F.lit(1), F.col("n")))
    fits = known.join(rules.select(F.col("host").alias("end"), F.col("path").alias("start"), "rule", "verdict", "nth"), ["end", "start"])
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("least"), "nth", "rule", "verdict")).alias("r"))
    return best.select("host", "path", "r.rule", "r.verdict")


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of links between hosts, each once. pages: host and html."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    found = pages.where(F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(links).alias("link"))
    found = found.select("src", F.translate("link", UPPER, LOWER).alias("dst"))
    return found.where("src <> '' and src <> dst").distinct()


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 8) -> DataFrame:
    """(host, trust, distrust). links: (src, dst); seeds: (host, trusted, blocked)."""
    both = links.select(F.lit(True).alias("trust"), F.col("src").alias("host"), F.col("dst").alias("to"))
    both = both.unionByName(links.select(F.lit(False).alias("trust"), F.col("dst").alias("host"), F.col("src").alias("to")))
    degree = both.groupBy("trust", "host").agg(F.count("*").alias("degree"))
    both = save(both.join(degree, ["trust", "host"]).select("trust", "host", "to", "degree"), "host-edges")
    start = seeds.select(F.lit(True).alias("trust"), "host", F.col("trusted").alias("rank")).unionByName(seeds.select(F.lit(False).alias("trust"), "host", F.col("blocked").alias("rank")))
    start = save(start.where("rank > 0"), "host-seeds")
    rank = start
    for i in range(rounds):
        moved = rank.join(both, ["trust", "host"]).select("trust", F.col("to").alias("host"), (F.col("rank") / F.col("degree") * damping).alias("rank"))
        own = start.select("trust", "host", (F.col("rank") * (1 - damping)).alias("rank"))
        rank = moved.unionByName(own).groupBy("trust", "host").agg(F.sum("rank").alias("rank"))
        if i % KEPT == KEPT - 1:
            rank = save(rank, "host-ranks")
    pick = lambda t: F.coalesce(F.sum(F.when(F.col("trust") == t, F.col("rank"))), F.lit(0.0))
    return rank.groupBy("host").agg(pick(True).alias("trust_score"), pick(False).alias("distrust_score")).withColumnsRenamed({"trust_score": "trust", "distrust_score": "distrust"})


def judge(df: DataFrame, rules: list[tuple[str, str]] | DataFrame = RULES, threshold: float = 1.0, damping: float = 0.85, rounds: int = 8, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of df: id, host, path, rule, verdict, and the host's trust and distrust."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    pages = df.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), F.col(f"`{html_col}`").alias("html"))
    urls = pages.select("id", "host", "path")
    found = save(ruled(urls.select("host", "path"), rules_table(df.sparkSession, rules)), "ruled-urls")
    judged = urls.join(found, ["host", "path"], "left")
    share = lambda v: (F.count(F.when(F.col("verdict") == v, 1)) / F.count("*")).cast("double")
    seeds = save(judged.groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked")), "host-shares")
    links = save(edges(pages), "host-links")
    scores = save(propagate(links, seeds.where("trusted > 0 or blocked > 0"), damping, rounds), "host-scores")
    none = F.lit(0.0)
    out = judged.join(scores, "host", "left").select("id", "host", "path", "rule", "verdict", F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust"))
    own = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "trust", "distrust")


def oracle(rules: list[tuple[str, str]] = RULES, threshold: float = 1.0, damping: float = 0.85, rounds: int = 8) -> str:
    """The same as SQL, its rounds one after the other."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    order = sorted(rules, key=lambda r: -len(r[1]))
    fits = [(f"(host = {quote(h)} or ends_with(host, {quote('.' + h)})) and starts_with(path, {quote(p)})", rule, v) for v, rule in order for h, p in [_split(rule)]]
    case = lambda i: "case " + " ".join(f"when {f[0]} then {quote(f[i])}" for f in fits) + " end"
    steps = "".join(
        f""", r{i} as (select trust, host, sum(rank) as rank from (
            select e.trust, e.dst as host, r.rank / e.degree * {damping} as rank from r{i - 1} r join e using (trust, host)
            union all select trust, host, rank * {1 - damping} from r0) group by 1, 2)"""
        for i in range(1, rounds + 1)
    )
    return f"""with p as (select page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') as host,
            coalesce(regexp_extract(url, '{URL}', 2), '') as path, html from pages),
        j as (select page_id, host, path, {case(1)} as rule, {case(2)} as verdict from p),
        s as (select host, count(*) filter (verdict = 'allow') / count(*) as trusted, count(*) filter (verdict = 'block') / count(*) as blocked from j group by host),
        l as (select distinct host as src, translate(link, '{UPPER}', '{LOWER}') as dst from
            (select host, unnest(regexp_extract_all(html, {quote(LINK)}, 1)) as link from p where html like '%//%') where host <> ''),
        b as (select true as trust, src as host, dst from l where src <> dst union all select false, dst, src from l where src <> dst),
        e as (select trust, host, dst, count(*) over (partition by trust, host) as degree from b),
        r0 as (select true as trust, host, trusted as rank from s where trusted > 0 union all select false, host, blocked from s where blocked > 0){steps},
        v as (select host, coalesce(sum(rank) filter (trust), 0) as good, coalesce(sum(rank) filter (not trust), 0) as bad from r{rounds} group by host)
        select page_id, host, path, rule, coalesce(verdict, case when coalesce(bad, 0) > {threshold} * coalesce(good, 0) then 'block' else 'allow' end) as verdict
        from j left join v using (host)"""
