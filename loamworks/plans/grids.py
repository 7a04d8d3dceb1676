"""Pixels as rows: colour swaps, ordered dither, image metrics, margins, seams, cuts, palettes, periods; rectangles in reading order; levels of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.functions import scalar
from loamworks.operators import grids, palettes, sheets
from loamworks.plans.registry import query
from loamworks.session import table

_PIXELS = """px AS (SELECT event_id // 1024 AS img, CAST(event_id % 32 AS INT) AS x, CAST(event_id % 1024 // 32 AS INT) AS y, CAST(event_id * 7 % 256 AS INT) AS r, CAST(event_id * 13 % 256 AS INT) AS g, CAST(floor(value) AS INT) % 256 AS b,
    CASE WHEN event_id % 10 = 0 THEN 0 ELSE 255 END AS a FROM events)"""
_GREY = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"
#: Colours that pixels are set to.
PALETTE = [(0, 0, 0), (255, 255, 255), (200, 60, 60), (60, 160, 70), (60, 80, 190), (230, 200, 80), (120, 120, 120), (7, 13, 11)]
_PALETTE = f"pal(k, pr, pg, pb) AS (VALUES {', '.join(f'({k}, {r}, {g}, {b})' for k, (r, g, b) in enumerate(PALETTE))})"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, x, y, r, g, b, a): images of 32 by 32 made of the events, the last perhaps not whole."""
    i, whole = F.col("event_id"), lambda c: c.cast("int")
    return table(spark, sf_dir, "events").select(
        F.floor(i / 1024).alias("img"), whole(i % 32).alias("x"), whole(F.floor(i % 1024 / 32)).alias("y"), whole(i * 7 % 256).alias("r"), whole(i * 13 % 256).alias("g"), (whole(F.floor("value")) % 256).alias("b"),
        F.when(i % 10 == 0, 0).otherwise(255).alias("a"),
    )


@query(
    f"""WITH {_PIXELS}, s AS (SELECT *, a > 0 AND sqrt((r - 120) ** 2 + (g - 130) ** 2 + (b - 40) ** 2) <= 90 AS hit, 0.2126 * (r - 120) + 0.7152 * (g - 130) + 0.0722 * (b - 40) AS d FROM px)
    SELECT img, x, y, CASE WHEN hit THEN greatest(0, least(255, round(0 + d, 6))) ELSE r END AS r, CASE WHEN hit THEN greatest(0, least(255, round(128 + d, 6))) ELSE g END AS g, CASE WHEN hit THEN greatest(0, least(255, round(255 + d, 6))) ELSE b END AS b FROM s"""
)
def colour_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One colour and what is near it replaced by another, light and shade kept."""
    out = grids.swap_colour(pixels(spark, sf_dir), (120, 130, 40), (0, 128, 255), 90, shading=True)
    return out.select("img", "x", "y", *[F.round(c, 6).alias(c) for c in "rgb"])


@query(
    f"""WITH {_PIXELS}, {_PALETTE}, m(i, v) AS (SELECT unnest(range(16)), unnest([0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5])),
    c AS (SELECT px.*, (v / 16.0 - 15 / 32.0) * 48 AS bias FROM px JOIN m ON i = y % 4 * 4 + x % 4 WHERE a > 0),
    d AS (SELECT img, x, y, k, (r + bias - pr) ** 2 + (g + bias - pg) ** 2 + (b + bias - pb) ** 2 AS d FROM c, pal)
    SELECT img, x, y, arg_min(k, (round(d, 6), k)) AS colour FROM d GROUP BY img, x, y"""
)
def ordered_dither(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel's palette entry, under a matrix of four by four."""
    return grids.dithered(pixels(spark, sf_dir), PALETTE, 4).select("img", "x", "y", F.col("colour").cast("int").alias("colour"))


@query(
    f"""WITH {_PIXELS}, q AS (SELECT *, r // 32 * 32 AS r2, g // 32 * 32 AS g2, b // 32 * 32 AS b2, CASE WHEN a > 0 THEN 250 ELSE 0 END AS a2 FROM px),
    e AS (SELECT img, sum((r - r2) ** 2 + (g - g2) ** 2 + (b - b2) ** 2) / (count(*) * 3) AS mse, sqrt(avg((a - a2) ** 2)) AS alpha FROM q GROUP BY img)
    SELECT img, round(mse, 6) AS mse, round(CASE WHEN mse > 0 THEN 10 * log10(65025 / mse) END, 6) AS psnr, round(alpha, 6) AS alpha_rmse, mse = 0 AND alpha = 0 AS exact FROM e"""
)
def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a coarser copy of each image is from it."""
    px = pixels(spark, sf_dir)
    copy = px.select("img", "x", "y", *[(F.floor(F.col(c) / 32) * 32).alias(c) for c in "rgb"], F.when(F.col("a") > 0, 250).otherwise(0).alias("a"))
    return grids.metrics(px, copy).withColumns({c: F.round(c, 6) for c in ("mse", "psnr", "alpha_rmse")})


@query(
    f"""WITH {_PIXELS}, o AS (SELECT * FROM px WHERE a > 0 AND r > 128), b AS (SELECT img, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM o GROUP BY img), s AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img),
    p AS (SELECT img, y, count(*) AS n FROM o GROUP BY ALL)
    SELECT img, x0 AS "left", y0 AS top, w - 1 - x1 AS "right", h - 1 - y1 AS bottom, (SELECT count(*) FROM p WHERE p.img = b.img) AS rows_used, (SELECT max(n) FROM p WHERE p.img = b.img) AS fullest FROM b JOIN s USING (img)"""
)
def image_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty margins around what an image shows, how many rows are in use, and how much the fullest holds."""
    px = pixels(spark, sf_dir)
    return grids.margins(px, (F.col("a") > 0) & (F.col("r") > 128))


_DELTA = "(abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b)) / 3.0"


@query(
    f"""WITH {_PIXELS}, e AS (SELECT p.img, avg({_DELTA}) AS edge FROM px p JOIN px q ON p.img = q.img AND p.y = q.y AND p.x = 31 AND q.x = 0 GROUP BY p.img),
    n AS (SELECT p.img, avg({_DELTA}) AS base FROM px p JOIN px q ON p.img = q.img AND p.y = q.y AND q.x = p.x + 1 GROUP BY p.img),
    m AS (SELECT p.img, avg({_DELTA}) AS match FROM px p JOIN px q ON q.img = p.img + 1 AND p.y = q.y AND p.x = 31 AND q.x = 0 GROUP BY p.img)
    SELECT img, round(edge, 6) AS edge, round(base, 6) AS base, edge <= greatest(2, base * 1.25) AS seamless, round(match, 6) AS next_edge, match <= greatest(2, base * 1.25) AS next_fits FROM e JOIN n USING (img) LEFT JOIN m USING (img)"""
)
def tile_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tiles repeat without a seam, and whether the next tile fits on the right."""
    out = grids.seams(pixels(spark, sf_dir), 32)
    return out.withColumns({c: F.round(c, 6) for c in ("edge", "base", "next_edge")})


@query(
    f"""WITH RECURSIVE {_PIXELS}, ink AS (SELECT img // 4 AS strip, CAST(img % 4 * 32 + y AS INT) AS y, avg(CASE WHEN r > 128 THEN 1.0 ELSE 0.0 END) AS ink FROM px GROUP BY ALL), h AS (SELECT strip, max(y) + 1 AS h FROM ink GROUP BY strip),
    c AS (SELECT strip, h, 0 AS n, 0 AS cut, 0.0::DOUBLE AS score FROM h UNION ALL SELECT * FROM (SELECT strip, any_value(h), any_value(n) + 1, arg_min(y, (round(s, 9), y)), min(s) FROM (
        SELECT c.strip, c.h, c.n, ink.y, ink.ink + abs(ink.y - c.cut - 24) / 8.0 * 0.15 AS s FROM c JOIN ink ON ink.strip = c.strip AND ink.y BETWEEN greatest(c.cut + 12, c.cut + 24 - 8) AND least(c.h - 12, c.cut + 24) WHERE c.cut + 24 < c.h) GROUP BY strip))
    SELECT strip, n AS nth, cut, CASE WHEN score > 0.35 THEN 'uncertain' ELSE 'candidate' END AS verdict FROM c WHERE n > 0"""
)
def strip_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where long strips may be cut: near the wanted height, through rows with little in them."""
    px = pixels(spark, sf_dir).withColumn("strip", F.floor(F.col("img") / 4)).withColumn("row", (F.col("img") % 4 * 32 + F.col("y")).cast("int"))
    ink = px.groupBy("strip", "row").agg(F.avg(F.when(F.col("r") > 128, 1.0).otherwise(0.0)).alias("ink"))
    return grids.suggested_cuts(ink, target=24, radius=8, least=12)


@query(
    f"""WITH {_PIXELS}, {_PALETTE}, d AS (SELECT img, x, y, k, (r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2 AS d FROM px, pal WHERE a > 0), n AS (SELECT img, x, y, arg_min(k, (d, k)) AS k, min(d) AS d FROM d GROUP BY ALL),
    s AS (SELECT img, k, count(*) AS n, count(*) FILTER (WHERE d = 0) AS exact FROM n GROUP BY ALL), t AS (SELECT img, sum(n) AS total FROM s GROUP BY img)
    SELECT t.img, pal.k AS colour, coalesce(n, 0) AS n, coalesce(exact, 0) AS exact, round(coalesce(n, 0) / total, 6) AS share FROM t CROSS JOIN pal LEFT JOIN s ON s.img = t.img AND s.k = pal.k"""
)
def palette_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each image each palette entry takes, and how much of that exactly; unused entries too."""
    return grids.palette_usage(pixels(spark, sf_dir), PALETTE).withColumn("share", F.round("share", 6))


@query(
    f"""WITH {_PIXELS}, c AS (SELECT x, y, img, r // 64 AS c, lag(r // 64) OVER (PARTITION BY x, y ORDER BY img) AS b, lag(r // 64, 2) OVER (PARTITION BY x, y ORDER BY img) AS bb FROM px WHERE a > 0)
    SELECT x, y, count(*) FILTER (WHERE b <> c) AS changes, count(*) FILTER (WHERE b <> c AND bb = c) AS flickers FROM c GROUP BY x, y"""
)
def flicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose colour changes from frame to frame, and how often straight back."""
    w = Window.partitionBy("x", "y").orderBy("img")
    c = pixels(spark, sf_dir).filter("a > 0").withColumn("c", F.floor(F.col("r") / 64)).withColumns({"b": F.lag("c").over(w), "bb": F.lag("c", 2).over(w)})
    changed = F.col("b") != F.col("c")
    return c.groupBy("x", "y").agg(F.count_if(changed).alias("changes"), F.count_if(changed & (F.col("bb") == F.col("c"))).alias("flickers"))


@query(
    f"""WITH {_PIXELS}, p AS (SELECT img, x, count(*) FILTER (WHERE a > 0 AND r > 128) AS n FROM px GROUP BY ALL), z AS (SELECT img, x, n - avg(n) OVER (PARTITION BY img) AS z FROM p),
    r AS (SELECT p.img, lag, sum(p.z * q.z) / (SELECT sum(z * z) FROM z WHERE z.img = p.img) AS r FROM z p JOIN (SELECT unnest(range(2, 17)) AS lag) ON true JOIN z q ON q.img = p.img AND q.x = p.x + lag GROUP BY p.img, lag)
    SELECT img, CAST(lag AS INTEGER) AS pitch, round(r, 6) AS score FROM r"""
)
def axis_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each pitch explains the columns of an image: autocorrelation of how full they are."""
    return grids.periods(pixels(spark, sf_dir), (F.col("a") > 0) & (F.col("r") > 128), range(2, 17)).withColumn("score", F.round("score", 6))


@query(
    """WITH r AS (SELECT o_custkey AS page, o_orderkey AS id, o_orderkey % 300 AS y, o_orderkey * 7 % 500 AS x, 10 + o_orderkey % 20 AS h FROM orders), t AS (SELECT page, greatest(2, floor(median(h) * 0.35 + 0.5)) AS tol FROM r GROUP BY page),
    c AS (SELECT r.*, tol, y + h / 2.0 AS centre, lag(y + h / 2.0) OVER (PARTITION BY r.page ORDER BY y + h / 2.0, x, id) AS prev FROM r JOIN t USING (page)),
    n AS (SELECT *, sum(CASE WHEN prev IS NULL OR centre - prev > tol THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY centre, x, id) AS line FROM c)
    SELECT page, id, CAST(line AS BIGINT) AS line, row_number() OVER (PARTITION BY page ORDER BY line, x, y, id) AS place FROM n"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles line by line, from left to right; what stands about as high is one line."""
    k = F.col("o_orderkey")
    boxes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), k.alias("id"), (k % 300).alias("y"), (k * 7 % 500).alias("x"), (k % 20 + 10).alias("h"))
    return grids.reading_order(boxes, "page")


@query(
    """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value - 50 AS v, lag(value - 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
    SELECT user_id, count(*) AS n, min(i) FILTER (WHERE abs(v) >= 20) AS starts, max(i) FILTER (WHERE abs(v) >= 20) AS ends, count(*) FILTER (WHERE (v >= 0) <> (b >= 0)) AS crossings, round(max(abs(v)), 6) AS peak, round(sqrt(avg(v * v)), 6) AS rms FROM s GROUP BY user_id"""
)
def sound_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a series is first and last louder than a threshold, how often it crosses zero, its peak and root mean square."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") - 50).alias("v"))
    return grids.levels(rows, "user_id", ["ts", "event_id"], "v", 20.0).withColumns({c: F.round(c, 6) for c in ("peak", "rms")})


@query(
    """WITH e AS (SELECT event_id, user_id, user_id % 10 AS net, epoch_us(ts) // 1000 AS t, event_type || (event_id % 2) AS h FROM events)
    SELECT event_id, EXISTS (SELECT 1 FROM e b WHERE b.h = e.h AND b.event_id <> e.event_id AND b.t BETWEEN e.t - 600000 AND e.t AND (b.t < e.t OR b.event_id < e.event_id))
        OR EXISTS (SELECT 1 FROM e b WHERE b.h = e.h AND b.net = e.net AND b.event_id <> e.event_id AND b.t BETWEEN e.t - 86400000 AND e.t AND (b.t < e.t OR b.event_id < e.event_id)) AS flood FROM e"""
)
def flood_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts whose text came from anywhere within ten minutes, or from the same network within a day."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("net"), scalar.millis(F.col("ts")).alias("t"), F.concat("event_type", F.col("event_id") % 2).alias("h"))
    last = lambda *keys: F.lag("t").over(Window.partitionBy(*keys).orderBy("t", "event_id"))
    near = lambda before, ms: F.coalesce(F.col("t") - before <= ms, F.lit(False))
    return rows.select("event_id", (near(last("h"), 600_000) | near(last("h", "net"), scalar.DAY_MS)).alias("flood"))


@query()
def median_cut_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A palette of eight colours for each image, by weighted median cut and Lloyd steps; its splits and steps are held against a plain version in the tests."""
    return palettes.palettes(pixels(spark, sf_dir), "img", 8)


_SHOWN = "x % 8 < 7 AND y % 8 < 7 AND (x % 8 = 0 OR r % 11 > 0)"


@query(
    f"""WITH {_PIXELS}, o AS (SELECT img, y, x, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS k FROM px WHERE {_SHOWN}) SELECT img, y, min(x) AS start, CAST(max(x) + 1 AS INTEGER) AS stop FROM o GROUP BY img, y, k"""
)
def sheet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of each row of each sheet that show something."""
    return sheets.runs(pixels(spark, sf_dir), F.expr(_SHOWN))


@query()
def sheet_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate grids of each sheet with their evidence, the likeliest first; candidates are held against a plain version, and planted grids found, in the tests."""
    out = sheets.grids(pixels(spark, sf_dir), F.expr(_SHOWN))
    return out.withColumns({c: F.round(c, 6) for c in ("consistency", "coverage", "cross", "outside", "split", "score")})
