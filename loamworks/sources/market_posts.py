"""Items for sale in the first posts of public boards: one post holds many, each with one model, one price and one capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.sources.feeds import balanced

#: References besides numeric ones.
REFERENCES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("euro", "€"), ("amp", "&"))
#: How parts are named.
MODEL = (
    r"(?i)(\b(?:RTX|GTX|RX)\s*\d{3,4}(?:\s*(?:Ti\s*Super|Super|Ti|XTX|XT|GRE))?\b|\bArc\s*[AB]\d{3}\b|(?:\bRyzen|라이젠)\s*(?:[3579]\s+)?\d{4,5}(?:X3D|X|G|F)?\b|\bi[3579][ -]\d{4,5}[A-Z]*\b|\bCore\s*Ultra\s*[579]\s*\d{3}[A-Z]*\b)"
)
#: Words of what isn't one used part: wanted, new, whole computers, bundles, broken or lone accessories.
UNWANTED = (
    r"(?i)(?:\b(?:WTB|WTT|wanted|buying|BNIB|NIB|sealed|brand new|laptop|notebook|gaming PC|computer|bundle|combo|for parts|broken|defective|waterblock|water block|wb|bracket|backplate|heatsink|riser|fan only|cooler only)\b"
    r"|\[ACH\]|\[ECH\]|\b(?:neuf|scellé|portable|lot indissociable|bo[iî]te (?:seule|vide)|carton seul)\b|삽니다|구매|구해|노트북|본체|세트|셋트|일괄|미개봉|불량|고장|박스만|워터블[럭록]|브라켓|지지대|라이저|방열판|쿨러만)"
)
#: Lines that end an item: rules, and other goods.
BOUNDARY = (
    r"(?i)^(?:[-=]{5,}|.*\b(?:CORSAIR Frame|bo[iî]tier|écran|ecran|alimentation|Ram DDR|Corsair Vengeance|sodimm|NVMe|case for sale|SSD|HDD|motherboard|mainboard|mobo)\b|.*(?:메인보드|케이스 판매|램 판매))"
)
#: Several pieces, or a price that isn't the asking price.
UNCLEAR = r"(?i)(?:\b(?:[2-9]\s*(?:cards|GPUs|pieces)|pair|each|MSRP|retail|paid|original price)\b|[2-9]\s*(?:개|대)|개당|구입가|구매가|정가|희망.*교환)"
#: A span of prices, money of other countries, words of what is sold, and of shipping that is paid.
SPAN = r"(?i)\d\s*(?:[-–—]|to|à)\s*\d[\d,. ]*\s*(?:€|euros?\b|[만천]?원)|(?:^|[\s:])[-–—]\s*\d[\d,. ]*\s*(?:€|euros?\b|[만천]?원)"
FOREIGN = r"(?i)\b(?:CAD|AUD|JPY|GBP)\b|(?:CA|AU|C|A)\$|£|¥|円"
OTHERS = {"EUR": r"(?i)€|\bEUR\b", "USD": r"(?i)\$|\bUSD\b", "KRW": r"(?i)원|\bKRW\b"}
SOLD = r"(?im)(?:\bSOLD\b|^vendu(?:e)?\b|vendu(?:e)?\s+(?:à|hors)|판매\s*완료|판완|등반완료|정복됨|등산\s*완|^완[)\]])"
SHIPPED = r"(?i)\bshipped\b|(?:배송|택배)비\s*포함|택포|\binclus\b|€\s*in\b"
CAPACITY = r"(?i)(\b\d{1,2}\s*(?:GB|Go)\b|\d{1,2}\s*기가)"
#: (how a price is written, with its number first; what the number must look like) by currency.
PRICES = {
    "KRW": (r"(?<![\d.,])(\d[\d,.]*(?:\s*[만천])?)\s*원", r"^(?:\d+(?:\.\d{1,2})?\s*[만천]|\d+|\d{1,3}(?:,\d{3})+)$"),
    "EUR": (r"(?i)(?<![\d.,])(\d[\d .,]*?)\s*(?:€|euros?\b)", r"^(?:\d+|\d{1,3}(?: \d{3})+)(?:[,.]\d{1,2})?$"),
    "USD": (r"\$\s*(\d[\d,.]*)", r"^(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d{1,2})?$"),
}


def post_text(html: Column) -> Column:
    """Lines of a post: scripts, styles, comments and struck-out text dropped, blocks on lines of their own, references decoded, spaces collapsed."""
    c = F.regexp_replace(html, r"(?is)<(script|style|del|s|strike)\b[^>]*>.*?</\1>", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"(?i)</?(?:p|div|li|tr|h[1-6])\b[^>]*>|<br\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    number = F.regexp_extract_all(c, F.lit(r"(?i)&#(x[\da-f]{1,6}|\d{1,7});"), 1)
    code = lambda n: F.when(F.lower(F.left(n, F.lit(1))) == "x", F.conv(F.substring(n, 2, 9), 16, 10)).otherwise(n).cast("bigint")
    letter = lambda n: F.when((code(n) > 0) & (code(n) <= 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code(n)), 8, "0")), "UTF-32")).otherwise("")
    c = F.aggregate(F.array_distinct(number), c, lambda text, n: F.replace(text, F.concat(F.lit("&#"), n, F.lit(";")), letter(n)))
    for name, char in REFERENCES:
        c = F.regexp_replace(c, f"(?i)&{name};", char)
    c = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\r")), "[\\t  ]+", " "), r"\n\s*\n", "\n")
    return F.btrim(c, F.lit(" \t\n "))


def models(text: Column) -> Column:
    """The parts that a text names, in order, as it names them but for spaces and the names' spelling."""
    found = F.regexp_extract_all(text, F.lit(MODEL), 1)
    spelled = lambda m: F.trim(F.regexp_replace(F.regexp_replace(F.replace(m, F.lit("라이젠"), F.lit("Ryzen")), r"\s+", " "), r"(?i)^(RTX|GTX|RX)\s*(\d)", "$1 $2"))
    case = lambda m: F.aggregate(F.array(*[F.struct(F.lit(rf"(?i)\b{v}\b").alias("p"), F.lit(v).alias("v")) for v in ("Ti", "Super", "XTX", "XT")]), m, lambda t, s: F.regexp_replace(t, s["p"], s["v"]))
    return F.transform(found, lambda m: case(spelled(m)))


def model_key(model: Column) -> Column:
    return F.regexp_replace(F.lower(model), "[^a-z0-9]", "")


def prices(text: Column, currency: str) -> Column:
    """The distinct well-written prices of a text."""
    written, shape = PRICES[currency]
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(written), 1), lambda p: F.trim(p)), lambda p: p.rlike(shape))
    times = lambda p: F.when(F.endswith(p, F.lit("만")), 10_000).when(F.endswith(p, F.lit("천")), 1_000).otherwise(1)
    plain = (lambda p: F.regexp_replace(F.regexp_replace(p, " ", ""), ",", ".")) if currency == "EUR" else (lambda p: F.regexp_replace(p, r"[,\s만천]", ""))
    return F.array_distinct(F.filter(F.transform(found, lambda p: plain(p).try_cast("double") * times(p)), lambda v: (v > 0) & (v < 1e9)))


def first_post(html: Column, opening: str, tag: str = "div") -> Column:
    """A page's first post: the element whose tag matches ``opening``, up to its own end tag, without what replies to it."""
    return balanced(html, opening, tag)


def items(posts: DataFrame, key: str, currency: str) -> DataFrame:
    """(key, place, model, capacity, price, shipping, basis, excluded): the items of posts (key, title, body html), excluded ones with what of them is known.

    A line that names one part begins an item, or goes on with it if it is the same; one that names several makes the item ambiguous; a line of other goods ends it. An item counts that has one price in the currency, at most
    one capacity, up to 2000 characters, and no sign of spans, other money, several pieces or unwanted goods; of equal ones in a post the first. A post with an unwanted title is one excluded row without a model.
    """
    c = F.col
    clean = posts.select(key, F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body")).withColumn("bad", c("title").rlike(UNWANTED))
    lines = clean.filter("NOT bad").select(key, "title", F.posexplode(F.filter(F.split(post_text(c("body")), "\n"), lambda x: x != "")).alias("line", "text"))
    lines = lines.withColumn("named", models(c("text"))).withColumn("keys", F.array_distinct(F.transform("named", model_key)))
    lines = lines.withColumns({"own": F.get("keys", 0), "many": F.size("keys"), "ends": (F.size("keys") == 0) & c("text").rlike(BOUNDARY)})
    order = Window.partitionBy(key).orderBy("line")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # a post's lines are few
    lines = lines.withColumn("state", F.when(c("own").isNotNull(), c("own")).when(c("ends"), F.lit(""))).withColumn("before", F.coalesce(F.last("state", ignorenulls=True).over(earlier), F.lit("")))
    lines = lines.withColumn("begins", (c("own").isNotNull() & ((c("many") > 1) | (c("before") != c("own")))).cast("int"))
    lines = lines.withColumns({"item": F.sum("begins").over(order), "within": F.coalesce(F.last("state", ignorenulls=True).over(order), F.lit(""))}).filter("within <> '' AND NOT ends")
    blocks = lines.groupBy(key, "item").agg(F.first("title").alias("title"), F.sort_array(F.collect_list(F.struct("line", "text", "named", "many"))).alias("l"))
    blocks = blocks.withColumns({"section": F.array_join(c("l")["text"], "\n"), "model": F.get(c("l")[0]["named"], 0), "ambiguous": c("l")[0]["many"] > 1})
    told = F.when((F.size(models(c("title"))) == 1) & (model_key(F.get(models(c("title")), 0)) == model_key(c("model"))), c("title")).otherwise("")
    capacities = F.array_distinct(F.transform(F.regexp_extract_all(F.concat("section", F.lit("\n"), told), F.lit(CAPACITY), 1), lambda x: F.regexp_extract(x, r"\d+", 0)))
    blocks = blocks.withColumns({"prices": prices(c("section"), currency), "capacities": capacities, "sold": F.concat("title", F.lit("\n"), "section").rlike(SOLD)})
    foreign = c("section").rlike(FOREIGN)
    for other, pattern in OTHERS.items():
        foreign = foreign if other == currency else foreign | c("section").rlike(pattern)
    odd = c("ambiguous") | (F.length("section") > 2000) | c("section").rlike(SPAN) | foreign | (F.size("capacities") > 1) | F.contains("section", F.lit("�")) | c("section").rlike(UNWANTED) | c("section").rlike(UNCLEAR) | (F.size("prices") != 1)
    rows = blocks.select(key, "item", "model", F.coalesce(F.get("capacities", 0), F.lit("")).alias("capacity"), F.get("prices", 0).alias("price"), F.when(c("section").rlike(SHIPPED), 0.0).alias("shipping"), F.when(c("sold"), "sold").otherwise("asking").alias("basis"), odd.alias("odd"))
    again = F.row_number().over(Window.partitionBy(key, "odd", model_key(c("model")), "capacity").orderBy("item")) > 1
    place = F.row_number().over(Window.partitionBy(key).orderBy("item")).cast("bigint")
    out = rows.withColumn("excluded", c("odd") | again).withColumn("place", place).select(key, "place", "model", "capacity", "price", "shipping", "basis", "excluded")
    whole = clean.filter("bad").select(key, F.lit(1).cast("bigint").alias("place"), *[F.lit(None).cast(t).alias(n) for n, t in (("model", "string"), ("capacity", "string"), ("price", "double"), ("shipping", "double"), ("basis", "string"))], F.lit(True).alias("excluded"))
    return out.unionByName(whole)
