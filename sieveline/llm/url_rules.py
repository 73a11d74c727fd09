"""URL filters by association rules.

Fixed rules (host suffix, path prefix) come first: the longest that fits a url
decides. For the other urls, FP-growth mines combinations of URL tokens that
go with a bad or a good label; rules that pass the bounds of support,
confidence and lift form an inverted index (rarest token of a rule -> rule),
urls look up their tokens, and of the rules whose tokens a url has, the most
confident decides: block for bad, allow for good.

Training uses every labelled page: bad means not of quality or toxic. Mining is
Spark's; rules are a table, never collected. The label is an item of its own,
so support and confidence are those of token combinations with the label.

Tokens that always go together (a scheme and a top domain, the fixed steps of
a site) would double the itemsets with each of them, without saying more. So
tokens found in the same labelled pages are mined as one item, named by the
longest of them, and a url has the item if it has any of its tokens: these are
the rules of all the choices of one token from each item, none is lost. Tokens
that all labelled pages have are left out (a rule with them is covered by the
one without), and those in fewer pages than a rule needs. All others are mined
for both labels, whether they tell something by themselves or not. Urls are
matched with all their tokens.

Defined results: a null url, or one without ://, has empty host and path, no
tokens and is allowed; a url of any length is matched with all its tokens; repeated rows each get their verdict; no labels or no
rule that passes means no blocks by the method; an empty table gives no rows;
clashing input columns are replaced.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import lower_ascii, replace_columns, written

#: (verdict, host, path prefix): the fixed rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.6, 1.1
#: A token combination must cover so many labelled pages at least, however few there are.
MIN_PAGES = 20
BAD, GOOD = "label=bad", "label=good"

OUT = ["host", "path", "tokens", "rule", "verdict", "mined_rule", "confidence"]


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule; null fields if none fits."""
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    out = none
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_tokens(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path and tokens (distinct): host with its parent domains, all path steps (digits as #), query keys,
    scheme, fragment."""
    df = (pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
          .withColumn("__url", F.coalesce(F.when(F.col(url).contains("://"), F.col(url)), F.lit("")))
          .withColumn("__labels", F.expr("array_remove(split(host, r'\\.'), '')")))
    parts = [
        F.expr("CASE WHEN size(__labels) > 0 THEN transform(sequence(1, size(__labels)), i -> "
               "concat('host=', array_join(slice(__labels, i, size(__labels)), '.'))) ELSE array() END"),
        F.expr("transform(filter(slice(split(path, '/'), 2, length(path) + 1), x -> x <> ''), "
               "x -> concat('step=', regexp_replace(x, r'[0-9]+', '#')))"),
        F.expr("transform(regexp_extract_all(__url, r'[?&]([^=&#]+)', 1), x -> concat('key=', x))"),
        F.expr("CASE WHEN __url = '' THEN array() ELSE array(concat('scheme=', lower(split_part(__url, '://', 1)))) END"),
        F.expr("CASE WHEN contains(__url, '#') THEN array('fragment') ELSE array() END"),
    ]
    return df.withColumn("tokens", F.array_distinct(F.concat(*parts))).drop("__url", "__labels")


def token_classes(labelled: DataFrame, least: float = 0) -> DataFrame:
    """(token, item, n, bad, all): every token of at least ``least`` pages that not all have, with the longest of the tokens
    in the same pages; ``labelled`` is a written (tokens, bad) table.

    Tokens have the same pages if they are in the same distinct token sets, which is compared by their number, sum
    and exclusive-or of hashes.
    """
    sets = labelled.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"))
    per = (sets.select(F.xxhash64("tokens").alias("h"), "n", "bad", F.explode("tokens").alias("token"))
           .groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"),
                                 F.expr("bit_xor(h)").alias("mix"), F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    total = labelled.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"))).scalar()
    per = per.withColumn("all", total).where((F.col("n") < F.col("all.n")) & (F.col("n") >= least))
    same = ["sets", "sum", "mix"]
    one = per.groupBy(*same).agg(F.max(F.struct(F.length("token"), "token"))["token"].alias("item"))
    return per.join(one, same).select("token", "item", "n", "bad", "all")


def mining_tokens(labelled: DataFrame, min_lift: float = MIN_LIFT) -> DataFrame:
    """(token, label): the items that go with a label by themselves (a look at the labels; mining takes all items)."""
    judged = token_classes(labelled).where("token = item")
    lift = lambda hits, base: F.expr(f"({hits}) * all.n >= {min_lift} * n * ({base})")
    return judged.select("token", F.explode(F.array_compact(F.array(
        F.when(lift("bad", "all.bad"), BAD), F.when(lift("n - bad", "all.n - all.bad"), GOOD)))).alias("label"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         min_lift: float = MIN_LIFT, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rules (rule_id, needs, label, confidence, support, lift, anchor) from (tokens, bad) rows; ``needs`` are items."""
    return mine_items(labelled, min_support, min_confidence, min_lift, min_pages)[0]


def mine_items(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_lift: float = MIN_LIFT, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """The rules of ``mine`` and the (token, item) table.

    Frequent token combinations that contain a label give the rules; a rule
    that a shorter one for its label with at least its confidence covers is
    pruned.
    """
    pages = written(labelled.where(F.size("tokens") > 0).select("tokens", "bad").withColumn(
        "__page", F.monotonically_increasing_id()), "url-labelled")
    n = max(1, pages.count())
    # Support of the label together with the tokens.
    support = max(min_support, min_pages * min_confidence / n)
    classes = written(token_classes(pages, support * n * (1 - 1e-9)).select("token", "item"), "url-tokens")
    mined = (pages.select("__page", F.explode("tokens").alias("token")).join(classes, "token")
             .groupBy("__page").agg(F.collect_set("item").alias("mined")))
    baskets = written(pages.join(mined, "__page", "left").select(F.concat(
        F.coalesce("mined", F.expr("array()")), F.array(F.when(F.col("bad"), BAD).otherwise(GOOD))).alias("items")),
        "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=min_confidence).fit(baskets)
    rules = (model.associationRules.withColumn("label", F.col("consequent")[0]).where(F.col("label").isin(BAD, GOOD))
             .where((F.col("lift") >= min_lift) & (F.col("support") * n >= min_pages * min_confidence))
             .select(F.array_sort("antecedent").alias("needs"), "label", "confidence", "support", "lift"))
    rules = written(rules.withColumn("rule_id", F.xxhash64("needs", "label")), "url-rules")
    short = rules.select(F.col("needs").alias("__less"), F.col("label").alias("__for"), F.col("confidence").alias("__c"))
    # A shorter rule that covers this one has one of this one's tokens as its first.
    covered = (rules.select("rule_id", "needs", "label", "confidence", F.explode("needs").alias("first"))
               .join(short, (F.col("first") == F.col("__less")[0]) & (F.col("label") == F.col("__for")))
               .where((F.size("__less") < F.size("needs")) & (F.col("__c") >= F.col("confidence"))
                      & (F.size(F.array_except("__less", "needs")) == 0)).select("rule_id").distinct())
    kept = rules.join(covered, "rule_id", "left_anti")
    # The anchor is the token with the fewest labelled pages, so that a common token does not gather all urls.
    often = baskets.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    anchors = (kept.select("rule_id", F.explode("needs").alias("token")).join(often, "token")
               .groupBy("rule_id").agg(F.min(F.struct("c", "token")).alias("a")))
    return written(kept.join(anchors, "rule_id").select("rule_id", "needs", "label", "confidence", "support", "lift",
                                                        F.col("a.token").alias("anchor")), "url-index"), classes


def best_rules(pages: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, rule, label, confidence): the most confident rule that fits each distinct token set, through the inverted
    index; ``classes`` gives the items of the tokens."""
    sets = (pages.select("tokens").distinct().withColumn("token", F.explode("tokens")).join(classes, "token")
            .groupBy("tokens").agg(F.collect_set("item").alias("items")))
    hits = (sets.select("tokens", "items", F.explode("items").alias("item")).join(rules, F.col("item") == F.col("anchor"))
            .where(F.size(F.array_except("needs", "items")) == 0))
    return (hits.groupBy("tokens").agg(F.max(F.struct("confidence", "lift", "label", "needs")).alias("m"))
            .select(F.col("tokens").alias("__tokens"), F.array_join("m.needs", " ").alias("mined_rule"),
                    F.col("m.label").alias("__label"), F.col("m.confidence").alias("__confidence")))


def filter_urls(pages: DataFrame, labels: DataFrame, url: str = "url", document: Column | None = None,
                min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
                min_lift: float = MIN_LIFT) -> DataFrame:
    """All pages with ``OUT``. ``labels`` has doc_id, quality and toxic (1 or 0).

    ``document`` is the id of the document that a page shows; by default the first number that is a step of the path.
    """
    base = replace_columns(pages, OUT)
    tokened = with_tokens(base, url)
    shown = F.expr("try_cast(regexp_extract(path, r'/([0-9]{1,18})', 1) AS long)") if document is None else document
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__page")).agg(
        (F.max(F.expr("coalesce(quality, 1) = 0")) | F.max(F.expr("coalesce(toxic, 0) = 1"))).alias("bad"))
    labelled = tokened.join(marks, shown == F.col("__page")).select("tokens", "bad")
    found = best_rules(tokened, *mine_items(labelled, min_support, min_confidence, min_lift))
    return (tokened.join(found, F.col("tokens") == F.col("__tokens"), "left")
            .withColumn("__fixed", fixed_rule(F.col("host"), F.col("path")))
            .withColumn("rule", F.col("__fixed.rule"))
            .withColumn("confidence", F.col("__confidence"))
            .withColumn("verdict", F.coalesce("__fixed.verdict", F.when(F.col("__label") == BAD, F.lit("block")),
                                              F.lit("allow")))
            .select(*[F.col(f"`{c}`") for c in base.columns], *OUT))
