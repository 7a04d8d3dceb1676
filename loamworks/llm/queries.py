"""The operators' queries on the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.llm import chat_format, embed_dedup, html_extract, imatch, langid, lexical_search, line_dedup, lm_scoring, packing, piece_codec, resampling, simhash, url_filter
from loamworks.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL where there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query()
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose fingerprints of 3-word shingles link at 2 differing bits or fewer."""
    found = simhash.classes(table(spark, sf_dir, "documents"), width=3, radius=2, words=1)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query(
    """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
    w AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, w.c FROM w JOIN l ON w.id = l.a)
    SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(w.c) AS component_id, e.vec_id = min(w.c) AS kept FROM embeddings e JOIN w ON e.vec_id = w.id GROUP BY e.vec_id"""
)
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of vectors linked at a cosine of 0.95 or more."""
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


#: (verdict, host, path)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _url_sql(d: float = url_filter.DAMPING, steps: int = 150) -> str:
    """The verdicts in SQL, by so many steps of propagation: 0.85^150 of a rank is far below the tolerance."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    aside, href = (x.replace("'", "''") for x in (url_filter.ASIDE, url_filter.HREF))
    return f"""WITH RECURSIVE parts AS (SELECT page_id, html, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
    split AS (SELECT page_id, html, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
    rules(verdict, h, p) AS (VALUES {rules}),
    fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS given
        FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
    judged AS (SELECT s.*, f.rule, f.given FROM split s LEFT JOIN fits f USING (page_id)),
    links AS (SELECT host AS src, {lower.format("dst")} AS dst, count(*) AS n FROM (SELECT host, unnest(regexp_extract_all(regexp_replace(html, '{aside}', ' ', 'g'), '{href}', 1)) AS dst FROM split)
        WHERE host <> '' AND host <> {lower.format("dst")} GROUP BY ALL),
    raw AS (SELECT 't' AS kind, src AS a, dst AS b, n FROM links UNION ALL SELECT 'd', dst, src, n FROM links),
    arcs AS (SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) AS w FROM raw),
    seeds AS (SELECT host, CASE given WHEN 'allow' THEN 't' ELSE 'd' END AS kind, count(*) AS x FROM judged WHERE given IS NOT NULL AND host <> '' GROUP BY ALL),
    flow AS (SELECT 0 AS step, kind, host, CAST({1 - d} * x AS DOUBLE) AS x FROM seeds
        UNION ALL SELECT f.step + 1, a.kind, a.b, sum({d} * f.x * a.w) FROM flow f JOIN arcs a ON f.kind = a.kind AND f.host = a.a WHERE f.step < {steps} GROUP BY ALL),
    ranks AS (SELECT host, coalesce(sum(x) FILTER (WHERE kind = 't'), 0) AS trust, coalesce(sum(x) FILTER (WHERE kind = 'd'), 0) AS distrust FROM flow GROUP BY host)
    SELECT page_id, j.host, path, rule, coalesce(given, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * (1 + {url_filter.TIE}) THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged j LEFT JOIN ranks r ON j.host = r.host"""


@query(_url_sql())
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; pages that no rule fits take the verdict of their host in the link graph."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query()
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query(
    r"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    told AS (SELECT k.doc_id, pos, line, c.key IS NOT NULL AND k.doc_id <> keeper AS lost FROM keyed k LEFT JOIN common c ON k.key = c.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256 FROM told GROUP BY doc_id"""
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of 40 code points or more that five or more documents share."""
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), 5, 40)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a model of the four fifths that are not held out."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


@query()
def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's piece ids and of the text that they decode to."""
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by the profiles of the two thirds that are not held out."""
    return langid.predict(table(spark, sf_dir, "documents"))


@query()
def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of an edited version, and their likeness."""
    return imatch.compare_edited(table(spark, sf_dir, "documents"))


@query(
    r"""WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w,
        row_number() OVER () AS r FROM documents),
    sizes AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM words WHERE len(w) > 0),
    asked AS (SELECT i, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
    held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, sizes GROUP BY term, n_docs),
    scored AS (SELECT i, r, CAST(sum(times * weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(words.w) * n_docs) // n_terms)))) AS BIGINT) AS score
        FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN words USING (r), sizes GROUP BY i, r),
    ranked AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored JOIN words USING (r) WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN (SELECT item_id, row_number() OVER () AS i FROM benchmark) USING (i) WHERE rank <= 10"""
)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


#: A conversation that speaks in control strings, besides the given ones.
CONTROL_TALK = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def _chat_sql(t: chat_format.Template = chat_format.TEMPLATE) -> str:
    """What reading back must give; a formatted text is as long as its parts and two characters more for each control string and one for each backslash."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    size = "length({0}) + (length({0}) - length(replace({0}, '\\', '')))" + "".join(f" + 2 * (length({{0}}) - length(replace({{0}}, {quoted(c)}, ''))) // {len(c)}" for c in t.control)
    fixed = len(t.before) + len(t.middle) + len(t.after)
    extra = ", ".join(f"({c}, {n}, {quoted(r)}, {quoted(x)})" for c, n, r, x in CONTROL_TALK)
    return f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES {extra}) v(conv_id, turn, role, text))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{t.learned}'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = '{t.learned}'), '')) AS loss_sha256,
        CAST(sum({fixed} + {size.format("role")} + length(role) - length(replace(role, chr(10), '')) + {size.format("text")}) AS BIGINT) AS formatted_chars FROM said GROUP BY conv_id"""


@query(_chat_sql())
def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations as read back from their formatted texts and loss masks; each is a reply tree without branches, scored by the length of its texts."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_TALK, given.schema)
    messages = chat_format.chains(given.unionByName(extra)).withColumn("score", F.char_length("text").cast("double"))
    return chat_format.digests(chat_format.format_trees(messages, 1), name="conv_id")


@query()
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's distribution, and the rank of those drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
