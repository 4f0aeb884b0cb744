"""URL filter: explicit rules first, a logistic regression on hashed character n-grams otherwise.

The host stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, the path from there up to
``?``, ``#`` or the end; without ``://``, and for null, both are empty. A rule is a host with a path
prefix; it holds for all subdomains, and the longest one that fits decides. All other URLs are judged
by a regression fitted on a small labelled table; an URL without any n-gram is allowed unless the
model's intercept says otherwise. Everything is local to a row and native; repeated rows get equal
verdicts, two rules of equal length cannot both fit unless they are the same, and a margin of exactly 0 allows.
Very long URLs are read whole, an empty table gives no rows, and columns other than ``page_id`` and ``url``
are not read and may bear any name.

The labelled table is made of names chosen by subject; no host name of it stands in the pages it is used on,
so that all of these are unseen."""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = (3, 4, 5)
BUCKETS = 8192
RIDGE = 0.005
#: Most labelled rows that a model is fitted on.
FIT_ROWS = 10_000
# Fixed values: (verdict, host, path prefix).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Names of hosts to be blocked, names of hosts to be allowed, what stands around them, and paths
# of either side.
BLOCKED_NAMES = """
    casino-bonus best-casino online-casino-club royalcasino casinoslots slots-jackpot jackpot-party
    poker-room pokerbonus betting-odds sportsbets livebets bet-bonus freespins free-roulette
    gambling-tips freegames-jackpot lottery-winner lotto-prizes win-prizes bigwins
    cheap-meds cheapviagra viagra-shop buy-cialis pills-online dietpills slimming-pills
    pharmacy-discount online-pharmacy no-prescription-meds steroids-shop cheap-tablets
    xxx-videos hotxxx adult-chat adultcams adult-dating porn-tube freeporn sexcams livesex sexy-girls
    escort-girls hot-singles nude-pics webcam-girls
    payday-loans quick-loans fastcash cash-advance free-money money-fast earn-money-now easy-credit
    bitcoin-doubler crypto-giveaway get-rich-quick forex-signals
    replica-watches replicabags fake-rolex cheap-handbags outlet-replica
    adserver ad-tracker clicktrack click-ads popup-ads adclicks tracking-pixel banner-ads trackstats
    spam-links linkspam linkfarm link-exchange seo-spam backlinks-cheap bulk-spam content-farm
    warez-download cracked-keygen torrent-cracks free-downloads-crack
""".split()
ALLOWED_NAMES = """
    garden city-news river history school kitchen library travel-maps music homes science
    linux-forum weather python-docs mother-care others theatre thornton north-shore south-bank
    old-mill new-town river-side mountain-hut harbour bakery carpenter orchard village-hall museum
    observatory physics chemistry mathematics biology geology astronomy literature poetry grammar
    translation dictionary encyclopedia archive gazette tribune chronicle herald journal review
    weekly-post daily-paper evening-standard radio-waves film-festival orchestra choir
    football tennis cycling swimming running-club hiking sailing climbing chess
    recipes cooking vegetables cheese-makers winery coffee-roasters tea-house restaurant
    hospital nursing dentist physiotherapy health-service medicine-journal
    university college kindergarten teachers students research-lab institute laboratory
    parliament ministry council townhall police fire-brigade post-office railway airport station
    hardware software engineering compilers databases networks security-notes open-data statistics
    trading-standards bank-holidays accounting insurance architects builders plumbers electricians
    photography painting sculpture ceramics knitting woodwork furniture
    northern-lights southern-cross eastern-market western-isles
""".split()
PREFIXES = ["", "www.", "m.", "blog.", "news.", "shop."]
ENDS = ["example.com", "example.net", "example.org"]
PATHS = [
    "/en/12", "/es/854/", "/fr/748", "/de/92.html", "/en/4", "/en/8410.html", "/fr/5/", "/de/131408",
    "/es/71", "/en/327/", "/", "", "/fr/101.html", "/de/6", "/es/99893/", "/en/545",
]
# Every name with all prefixes and six of the paths, so that neither speaks for a side; 1 is to be
# blocked.
LABELLED = [
    (
        f"http://{PREFIXES[(i + k) % len(PREFIXES)]}{name}.{ENDS[(i + 2 * k) % len(ENDS)]}"
        f"{PATHS[(5 * i + k) % len(PATHS)]}",
        label,
    )
    for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES))
    for i, name in enumerate(names)
    for k in range(len(PREFIXES))
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(url, pattern, 1)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``verdict, rule`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, own, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        within = (host == own) | host.endswith(f".{own}")
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(own + prefix).alias("rule"))
        found = F.when(within & path.startswith(prefix), value).otherwise(found)
    return found


def buckets(host: Column, path: Column) -> Column:
    """Buckets of the character n-grams of both parts, apart from each other."""
    return F.array_distinct(
        F.concat(
            *[
                F.when(F.length(part) >= n, _grams(mark, part, n)).otherwise(
                    F.array().cast("array<int>")
                )
                for mark, part in (("h", host), ("p", path))
                for n in SIZES
            ]
        )
    )


def _grams(mark: str, part: Column, n: int) -> Column:
    # Split once into an array of one element, as taking parts of a text by position reads it from the start.
    return F.flatten(
        F.transform(
            F.array(F.split(part, "")),
            lambda own: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(part) - (n - 1), F.lit(1))),
                lambda i: F.pmod(
                    F.xxhash64(F.lit(mark), F.concat(*[F.get(own, i + (k - 1)) for k in range(n)])),
                    F.lit(BUCKETS),
                ).cast("int"),
            ),
        )
    )


def fit(labelled: DataFrame) -> tuple[float, list[float]]:
    """Intercept and bucket weights from ``url, label`` (0 allow, 1 block); at most ``FIT_ROWS``
    rows, those with the smallest hash. Weights are rounded, as sums may differ in the last bits."""
    host, path = host_and_path(F.col("url"))
    own = buckets(F.col("host"), F.col("path"))
    chosen = labelled.filter(F.col("label").isin(0, 1)).orderBy(F.xxhash64("url"), "url", "label")
    rows = chosen.limit(FIT_ROWS).select("label", host.alias("host"), path.alias("path"))
    # A column of its own with a one for every bucket of the row, as a sparse vector.
    numbers = [str(b) for b in range(BUCKETS)]
    sparse = CountVectorizerModel.from_vocabulary(numbers, "own", "features")
    rows = rows.withColumn("own", own.cast("array<string>"))
    rows = sparse.transform(rows).select(F.col("label").cast("double"), "features")
    model = LogisticRegression(regParam=RIDGE, standardization=False, maxIter=50).fit(
        rows.coalesce(1)
    )
    return round(model.intercept, 6), [round(w, 6) for w in model.coefficients.toArray().tolist()]


def default_model(spark: SparkSession) -> tuple[float, list[float]]:
    lines = "\n".join(f"{label}\t{url}" for url, label in LABELLED)
    line = F.split("line", "\t")
    rows = spark.range(1).select(F.explode(F.split(F.lit(lines), "\n")).alias("line"))
    return fit(rows.select(line[1].alias("url"), line[0].cast("int").alias("label")))


def judge(
    pages: DataFrame, model: tuple[float, list[float]], rules: list[tuple[str, str, str]]
) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` for every row of ``pages``."""
    intercept, weights = model
    host, path = host_and_path(F.col("url"))
    # One text literal, folded into one array when the plan is made.
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = parted.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules))
    total = F.aggregate(
        buckets(F.col("host"), F.col("path")),
        F.lit(float(intercept)),
        lambda s, b: s + F.element_at(table, b + 1),
    )
    scored = ruled.withColumn("margin", total)
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("margin") > 0, "block").otherwise("allow")).alias(
            "verdict"
        ),
        (1 / (1 + F.exp(-F.col("margin")))).alias("block_score"),
    )
