"""URL filters: host and path rules, and logistic regression on hashed character n-grams.

The regression is trained on the driver from a small labelled table of URLs (LABELLED, or one
that is passed, of at most MAX_LABELLED rows) and applied with SQL expressions only: the
n-grams of host and path are hashed by arithmetic on their code points into DIM buckets, and
the weights are whole numbers (millionths), so that sums are exact in any order and in any
SQL engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

DIM = 2048
GRAMS = (3, 4)
SCALE = 1_000_000
MAX_LABELLED = 10_000
EPOCHS = 120

#: (host, path, verdict): of the rules that fit, the longest wins.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: A small labelled URL table: 1 for URLs to block (spam, adult, gambling, trackers, shells of
#: link farms), 0 for URLs to allow (articles, references, public bodies).
LABELLED = [
    ("http://news.example.net/world/2021/05/city-council-votes", 0),
    ("https://docs.example.net/en/guide/install.html", 0),
    ("https://wiki.example.net/en/History_of_bridges", 0),
    ("https://library.example.net/catalogue/item/4821", 0),
    ("http://blog.gardens.example.net/fr/plantes/roses", 0),
    ("https://university.example.net/research/papers/2019/graph", 0),
    ("https://museum.example.net/en/exhibitions/stone-age", 0),
    ("https://health.example.net/de/ratgeber/schlaf", 0),
    ("http://www.weather.example.net/en/forecast/8812", 0),
    ("https://recipes.example.net/es/sopa-de-verduras", 0),
    ("https://science.example.net/articles/tides-and-moon", 0),
    ("https://forum.example.net/thread/1203/how-to-fix-a-chair", 0),
    ("https://m.travel.example.net/en/5512", 0),
    ("http://school.example.net/lessons/algebra/12", 0),
    ("https://blog.maps.example.net/en/3310", 0),
    ("https://www.theatre.example.net/fr/saison/7712", 0),
    ("https://archive.example.net/letters/1904", 0),
    ("https://law.example.net/en/statutes/chapter-7", 0),
    ("https://open.data.example.net/tables/rivers", 0),
    ("http://city.example.net/es/servicios/agua", 0),
    ("https://code.example.net/manual/en/strings.html", 0),
    ("https://m.birds.example.net/en/2214.html", 0),
    ("https://choir.example.net/de/konzerte/4417", 0),
    ("https://trains.example.net/en/timetable/north", 0),
    ("http://casino-bonus.example.net/free-spins/win", 1),
    ("https://xxx-cams.example.net/live/adult/1", 1),
    ("http://cheap-pills.example.net/buy-now?id=7", 1),
    ("https://click.tracker.example.net/ads/redirect/9912", 1),
    ("http://slots.example.net/jackpot/casino/bonus", 1),
    ("https://adult.example.net/porn/videos/551", 1),
    ("http://win-prize.example.net/free-iphone/claim", 1),
    ("https://bet365x.example.net/poker/bonus/index", 1),
    ("http://replica-watches.example.net/buy/cheap", 1),
    ("https://ads.example.net/banner/popunder.html", 1),
    ("http://seo-links.example.net/link/exchange/99", 1),
    ("https://loan-fast.example.net/payday/apply-now", 1),
    ("http://warez.example.net/download/crack/keygen", 1),
    ("https://torrent.example.net/free/movies/cam-rip", 1),
    ("http://spam.example.net/promo/casino", 1),
    ("https://pills.example.net/viagra/discount", 1),
    ("https://promo.offers.example.net/deal/click-here", 1),
    ("http://sex-chat.example.net/adult/free", 1),
    ("https://track.pixel.example.net/t?u=1", 1),
    ("http://crypto-doubler.example.net/bonus/free-coins", 1),
    ("https://escort.example.net/adult/city/12", 1),
    ("http://parked.example.net/buy-this-domain", 1),
    ("https://lottery.example.net/winner/claim/44", 1),
    ("http://fake-degree.example.net/buy/diploma", 1),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _split(url: str) -> tuple[str, str]:
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def _buckets(host: str, path: str) -> list[int]:
    text, out = f"^{host}|{path}$", []
    for n in GRAMS:
        for i in range(len(text) - n + 1):
            h = n
            for c in text[i : i + n]:
                h = (h * 131 + ord(c)) % 1_000_003
            out.append(h % DIM)
    return out


def train(labelled: list[tuple[str, int]] | None = None, epochs: int = EPOCHS) -> tuple[list[int], int]:
    """(weights, bias) in millionths: gradient descent on the mean logistic loss, always in one order.

    An empty table, or one with one class only, still gives a model; it follows the labels it has.
    """
    rows = [(_buckets(*_split(u)), y) for u, y in (LABELLED if labelled is None else labelled)]
    w, bias = [0.0] * DIM, 0.0
    for epoch in range(epochs):
        rate = 0.5 / (1 + 0.02 * epoch)
        for x, y in rows:
            z = bias + sum(w[i] for i in x) / math.sqrt(len(x))
            step = rate * (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            bias += 0.1 * step
            for i in x:
                w[i] += step / math.sqrt(len(x)) - 1e-4 * rate * w[i]
    return [round(v * SCALE) for v in w], round(bias * SCALE)


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The index of the longest rule that fits, or null."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0] + rules[i][1]), i))
    fits = [F.when(((host == rules[i][0]) | host.endswith("." + rules[i][0])) & path.startswith(rules[i][1]), F.lit(i)) for i in order]
    return F.coalesce(*fits) if fits else F.lit(None).cast("int")


def _score(host: Column, path: Column, weights: list[int], bias: int) -> Column:
    """The sum of the n-gram weights over the root of their number, and the bias; above 0 is blocked.

    With S the weights' sum and n the number of n-grams, S / sqrt(n) + bias.
    """
    table = F.lit(weights)
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))
    codes = F.transform(F.split(text, ""), F.ascii)
    length = F.size(codes)
    total, count = F.lit(0).cast("long"), F.lit(0)
    for n in GRAMS:
        places = F.when(length >= n, F.sequence(F.lit(1), length - n + 1)).otherwise(F.array().cast("array<int>"))

        def bucket(i: Column) -> Column:
            h = F.lit(n).cast("long")  # noqa: B023 (called at once)
            for k in range(n):
                h = (h * 131 + F.element_at(codes, i + k)) % 1_000_003
            return F.element_at(table, (h % DIM).cast("int") + 1).cast("long")

        total = F.aggregate(F.transform(places, bucket), total, lambda a, x: a + x)
        count = count + F.greatest(length - n + 1, F.lit(0))
    return total / F.sqrt(count.cast("double")) + bias


def judged(
    urls: DataFrame, url_col: str = "url", carry: list[str] | None = None, rules: list[tuple[str, str, str]] | None = None, labelled: list[tuple[str, int]] | DataFrame | None = None
) -> DataFrame:
    """``row`` (struct of the columns ``carry``, all by default), ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    ``rule`` is the longest rule that fits the host (or a domain above it) and begins the
    path, as text, null if none does; ``verdict`` is the rule's, else the regression's. A URL
    that is null or has no ``://`` has an empty host and path and gets the regression's verdict
    on them. ``labelled``: pairs of URL and 0 or 1, or a table (url, label) of at most
    MAX_LABELLED rows. Extra columns travel inside ``row`` only.
    """
    if isinstance(labelled, DataFrame):
        got = labelled.where("url is not null and label is not null").select("url", "label").orderBy("url", "label").limit(MAX_LABELLED + 1).collect()
        if len(got) > MAX_LABELLED:
            raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
        labelled = [(r["url"], int(r["label"])) for r in got]
    rules = RULES if rules is None else rules
    weights, bias = train(labelled)
    host, path = host_and_path(urls[url_col])
    got = urls.select(packed(urls, carry).alias("row"), host.alias("host"), path.alias("path"))
    got = got.withColumns({"at": _rule(F.col("host"), F.col("path"), rules), "score": _score(F.col("host"), F.col("path"), weights, bias)})
    name, verdict = F.lit(None).cast("string"), F.when(F.col("score") > 0, "block").otherwise("allow")
    for i, (h, p, v) in enumerate(rules):
        name, verdict = F.when(F.col("at") == i, h + p).otherwise(name), F.when(F.col("at") == i, v).otherwise(verdict)
    return got.select("row", "host", "path", name.alias("rule"), verdict.alias("verdict"), "score")


def allowed(urls: DataFrame, url_col: str = "url", **options) -> DataFrame:
    """The rows of ``urls`` that are allowed, with their own columns only."""
    got = judged(urls, url_col, **options).where("verdict = 'allow'")
    return got.select(*[F.col("row").getField(c).alias(c) for c in urls.columns])


def op7_url_filter(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return judged(pages, carry=["page_id"]).select("row.page_id", "host", "path", "rule", "verdict")


def op7_sql() -> str:
    """The same for DuckDB, with the trained weights written in."""
    weights, bias = train()
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in order]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits) + " ELSE NULL END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " WHEN score > 0 THEN 'block' ELSE 'allow' END"

    def bucket(n: int) -> str:
        h = str(n)
        for k in range(n):
            h = f"(({h} * 131 + unicode(substr(t, i + {k}, 1))) % 1000003)"
        return f"list_transform(range(1, greatest(length(t) - {n} + 2, 1)), lambda i: w[CAST({h} % {DIM} AS BIGINT) + 1])"

    grams = f"list_concat({bucket(GRAMS[0])}, {bucket(GRAMS[1])})"
    return f"""
WITH weights AS (SELECT {weights} AS w),
cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
grams AS (SELECT page_id, host, path, {grams} AS g FROM (SELECT *, '^' || host || '|' || path || '$' AS t FROM cut), weights),
scored AS (SELECT *, list_sum(g) / sqrt(CAST(len(g) AS DOUBLE)) + {bias} AS score FROM grams)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM scored
"""
