"""Text rules over documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import language_model, understand
from ..sources.tables import html_text, path_language, table
from .registry import PARTS, query

W = text.BLANK
T = text.TOKEN
_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_PAGE = ", ".join(f"'{w}'" for w in text.PAGE_WORDS)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _digest(spark: SparkSession, sf_dir: str, made: Column) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", made.alias("t")).select("doc_id", F.md5("t").alias("md5"), F.length("t").cast("long").alias("n_chars"))


def _sub(t: str, *rules: tuple[str, str]) -> str:
    for a, b in rules:
        t = f"regexp_replace({t}, '{a}', '{b}', 'g')"
    return t


_PLAIN = f"translate({_sub('text', (r'[\x{E000}-\x{F8FF}]', ''))}, '’‘“”–—' || chr(160) || chr(173), chr(39) || chr(39) || '\"\"-- ')"
for _a, _b in text.LIGATURES.items():
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b}')"
_JOINED = _sub(_PLAIN, (rf"({T})-\n({T})", r"\1\2"))
_BASIC = _sub(_JOINED, (rf"(?m)^{W}*\d{{1,4}}{W}*$", ""))
_COLLAPSED = f"trim({_sub(_BASIC, (W + '+', ' '))})"
_CLEAN = f"coalesce(lower({_COLLAPSED}), 'Unknown')"


def _digest_sql(made: str) -> str:
    return f"SELECT doc_id, md5(t) AS md5, length(t) AS n_chars FROM (SELECT doc_id, {made} AS t FROM documents)"


@query("SELECT doc_id, text, lang, source FROM documents")
def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "text", "lang", "source")


_HTML = r"""trim(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x0B]+', ' ', 'g'))"""


@query(f"SELECT page_id, {_HTML.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, length({_HTML.format('html')}) AS body_chars FROM pages")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = html_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.length(html_text(F.col("html"))).cast("long").alias("body_chars"))


@query("""SELECT page_id, CASE WHEN list_contains(string_split(replace(url, chr(92), '/'), '/'), 'english') THEN 'english'
WHEN list_contains(string_split(replace(url, chr(92), '/'), '/'), 'telugu') THEN 'telugu' END AS language FROM pages""")
def path_language_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", path_language(F.col("url")).alias("language"))


@query(f"SELECT doc_id, length(text) AS n FROM documents WHERE length({_sub('text', (f'^{W}+|{W}+$', ''))}) > 0")
def nonempty_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(F.length(text.collapse(F.col("text"))) > 0).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 40")
def min_len_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(F.length("text") >= 40).select("doc_id", F.length("text").cast("long").alias("n"))


@query(r"""SELECT conv_id, turn, CASE WHEN e = '' THEN 200 ELSE 400 END::BIGINT AS status, e AS error FROM (
SELECT conv_id, turn, CASE WHEN n = 0 THEN 'empty' WHEN n > 3000 THEN 'too long' ELSE '' END AS e FROM (
SELECT conv_id, turn, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS n FROM conversations WHERE role = 'user'))""")
def api_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, error = understand.validated(F.col("text"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", status.alias("status"), error.alias("error"))


@query()
def clean_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full clean, with ASCII folding in its place."""
    from ..shipping import ship

    ship(spark)
    return _digest(spark, sf_dir, text.clean_english(F.col("text")))


_MINIMAL = f"coalesce(trim({_sub(_JOINED, (W + '+', ' '))}), '')"
_OCR = f"coalesce(trim({_sub('text', (rf'(?m)^{W}*\d{{1,4}}{W}*$', ''), (rf'({T})-\n({T})', r'\1\2'), (W + '+', ' '))}), '')"


@query(_digest_sql(_MINIMAL))
def clean_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir, text.clean_minimal(F.col("text")))


@query(_digest_sql(_OCR))
def clean_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir, text.clean_ocr(F.col("text")))


@query(_digest_sql(_CLEAN))
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir, text.clean(F.col("text")))


@query(_digest_sql(f"CASE WHEN lang = 'en' THEN trim({_sub(_sub(_COLLAPSED, (r'[^\x00-\x7F]', '')), (W + '+', ' '))}) ELSE {_COLLAPSED} END"))
def clean_text_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir, text.clean_by_language(F.col("text"), F.col("lang")))


@query(_digest_sql(_sub(_JOINED, (r"(?im)^\s*page\s+\d+\s*(of\s+\d+)?\s*$", ""), (r"(?im)^\s*\d{1,4}\s*$", ""),
                        (r"(?im)^\s*(table\s+of\s+contents|references)\s*$", ""), (r"[ \t]+", " "), (r"\n{3,}", chr(10) * 2),
                        (f"^{W}+|{W}+$", ""))))
def strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir, text.strip_boilerplate(F.col("text")))


_TITLE = "regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"


@query(f"SELECT page_id, trim({_sub(_CLEAN.replace('Unknown', 'unknown').replace('regexp_replace(text,', f'regexp_replace({_HTML.format(_TITLE)},', 1), (r'^([a-z]|[ivxlcdm]+|[0-9]+)(\.[0-9]+)*\.\s*', ''), ('^[-•–―]\\s*', ''))}) AS heading FROM pages")
def clean_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = html_text(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return table(spark, sf_dir, "pages").select("page_id", text.clean_heading(title).alias("heading"))


@query()
def ascii_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..shipping import ship

    ship(spark)
    return _docs(spark, sf_dir).select("doc_id", text.ascii_fold(F.col("text")).alias("text"))


_SANE = f"trim({_sub('text', (r'[^\x{0C00}-\x{0C7F}\x20-\x7E\t\n\r]', ''), (r'\s+', ' '))})"


@query(_digest_sql(_SANE))
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir, text.sanitize(F.col("text")))


@query(_digest_sql(_sub("text", (text.FOOTER, ""), (r"(?m)^\s*[0-9]+\s*$", ""), (r"(?m)^(CHAPTER\s*-\s*[IVXLCDM]+.*)", r"# \1"),
                        (r"(?m)^(Sec\.\s*[0-9]+\..*)", r"## \1"), (r"(?im)^(MODULE\s+[IVXLCDM]+.*)", r"# \1"),
                        (r"(?m)^([0-9]+\.\s+[A-Z\s]{4,})", r"## \1"), (r"(?im)^([A-Z\s]{5,}\s+COMPONENT.*)", r"## \1"),
                        (r"\n{3,}", chr(10) * 2), (f"^{W}+|{W}+$", ""))))
def promote_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir, text.promote_headings(F.col("text")))


_WORDS = f"list_filter(regexp_extract_all(lower(text), '{T}'), lambda w: regexp_full_match(w, '[a-z]{{{{{{}},}}}}'))"


CORRUPT_SQL = f"""SELECT doc_id, n_words, n_stop, n >= 50 AND n_words >= 15 AND n_stop * 10 < n_words AS corrupted FROM (
SELECT doc_id, length({_sub('text', (f'^{W}+|{W}+$', ''))}) AS n, len(w) AS n_words, len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop
FROM (SELECT doc_id, text, list_filter(regexp_extract_all(lower(text), '{T}'), lambda w: regexp_full_match(w, '[a-z]{{2,}}')) AS w FROM given_rows))"""


def corrupted(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_stop, corrupted of (doc_id, text)."""
    body = F.regexp_replace("text", rf"^{W}+|{W}+$", "")
    counted = rows.select("doc_id", F.length(body).alias("n"), text.words(F.col("text"), 2).alias("w")).select(
        "doc_id", "n", F.size("w").cast("long").alias("n_words"), F.size(F.filter("w", lambda x: x.isin(*text.STOP_WORDS))).cast("long").alias("n_stop")
    )
    return counted.select("doc_id", "n_words", "n_stop", ((F.col("n") >= 50) & (F.col("n_words") >= 15) & (F.col("n_stop") * 10 < F.col("n_words"))).alias("corrupted"))


@query(CORRUPT_SQL.replace("given_rows", "documents"))
def corruption_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged by the whole text."""
    return corrupted(_docs(spark, sf_dir))


@query(f"""SELECT doc_id, CASE WHEN n < 30 THEN false WHEN odd * 20 > n THEN true
WHEN len(e) >= 4 AND len(list_filter(e, lambda w: NOT regexp_matches(w, '[aeiouy]'))) * 10 > len(e) * 4 THEN true
WHEN len(e) >= 4 AND len(list_filter(e, lambda w: w IN ({_PAGE}))) = 0 THEN true
WHEN n > 100 AND len(e) < 4 AND script * 20 < n AND digits * 4 < n THEN true ELSE false END AS corrupted FROM (
SELECT doc_id, length(b) AS n, length({_sub('b', (r'[\x00-\x7F\x{0C00}-\x{0C7F}]|[^\p{L}\p{N}_]', ''))}) AS odd,
list_filter(regexp_extract_all(lower(b), '{T}'), lambda w: regexp_full_match(w, '[a-z]{{3,}}')) AS e,
length({_sub('b', (r'[^\x{0C00}-\x{0C7F}]', ''))}) AS script, length({_sub('b', ('[^0-9]', ''))}) AS digits
FROM (SELECT doc_id, {_sub('text', (f'^{W}+|{W}+$', ''))} AS b FROM documents))""")
def page_corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.page_corrupted(F.col("text")).alias("corrupted"))


@query(r"""SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (
SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)),
lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "sentence"
    )


@query("SELECT doc_id, left(string_split(text, chr(10))[1], 80) AS heading FROM documents")
def first_line_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.left(F.substring_index("text", "\n", 1), F.lit(80)).alias("heading"))


@query("SELECT page_id, left(md5(lower(url)), 12) AS key FROM pages")
def path_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents named by their whole path."""
    return table(spark, sf_dir, "pages").select("page_id", F.left(F.md5(F.lower("url")), F.lit(12)).alias("key"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 1000 THEN 'skip' WHEN text IS NULL THEN 'make' ELSE 'remake' END AS action FROM documents")
def output_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the bytes of what was put out before: only more than 1,000 are taken as done; 1,000 or fewer are made anew."""
    return _docs(spark, sf_dir).select("doc_id", understand.output_action(F.octet_length("text")).alias("action"))


@query("SELECT doc_id, left(md5(lower(source || '::' || doc_id || '.pdf')), 12) AS key FROM documents")
def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", ids.doc_key(F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("key"))


def uuid5_sql(name: str) -> str:
    h = f"sha1(unhex('{ids.DNS}') || encode({name}))"
    return (
        f"{h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || "
        f"substr('89ab', (('0x' || {h}[17:17])::INTEGER % 4) + 1, 1) || {h}[18:20] || '-' || {h}[21:32]"
    )


@query(f"SELECT doc_id, {uuid5_sql("left(md5(doc_id::VARCHAR), 12) || '-0000'")} AS point_id FROM documents")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = ids.chunk_id(F.left(F.md5(F.col("doc_id").cast("string")), F.lit(12)), F.lit(0))
    return _docs(spark, sf_dir).select("doc_id", ids.uuid5(name).alias("point_id"))


_ROMAN = ", ".join(f"'{w}'" for w in understand.ROMANISED)


def _any(t: str, phrases) -> str:
    e = r"[^\p{L}\p{N}_]"
    return f"regexp_matches({t}, '(^|{e})({'|'.join(phrases)})({e}|$)')"


@query(rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[\x{{0C00}}-\x{{0C7F}}]') THEN 'Telugu'
WHEN list_has_any(regexp_extract_all(lower(text), '{T}'), [{_ROMAN}]) THEN 'Telugu' ELSE 'English' END AS language FROM conversations WHERE role = 'user'""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", understand.language(F.col("text")).alias("language"))


#: Documents by a digest of their id: a quarter is held out of what the language model learns from.
HELD_OUT = "left(md5({}), 1) IN ('0', '1', '2', '3')"


def _trigrams_sql(table_: str, cols: str) -> str:
    return f"""SELECT DISTINCT r, {cols}, unnest(list_transform(range(1, length(w) + 1), lambda i: substring('_' || w || '_', i::INTEGER, 3))) AS g
FROM (SELECT *, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{T}'))) AS w FROM {table_})"""


PARTS["lang_rows"] = f"SELECT doc_id AS r, doc_id, text, lang, {HELD_OUT.format('doc_id::VARCHAR')} AS held_out FROM documents"
PARTS["lang_sizes"] = "SELECT lang, count(*) AS n FROM lang_rows WHERE NOT held_out AND text IS NOT NULL AND lang IS NOT NULL GROUP BY lang"
PARTS["lang_grams"] = _trigrams_sql("lang_rows", "lang, held_out")
PARTS["lang_counts"] = "SELECT lang, g, count(*) AS c FROM lang_grams WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g"
PARTS["lang_weights"] = """SELECT k.g, s.lang, ln((coalesce(c.c, 0) + 0.5e0) / (s.n + 1e0)) AS w FROM (SELECT DISTINCT g FROM lang_counts) k CROSS JOIN lang_sizes s
LEFT JOIN lang_counts c ON c.g = k.g AND c.lang = s.lang"""


def _best_sql(rows: str, grams: str, shown: str) -> str:
    return f"""SELECT {shown}, lang AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, lang) AS nth FROM (
SELECT * EXCLUDE (sw), round(coalesce(sw, 0) + ln(n / (SELECT sum(n) FROM lang_sizes)), 6) AS score FROM (
SELECT q.* EXCLUDE (lang, text), s.lang, s.n, sw FROM {rows} q CROSS JOIN lang_sizes s
LEFT JOIN (SELECT g.r, w.lang, sum(w.w) AS sw FROM {grams} g JOIN lang_weights w ON w.g = g.g GROUP BY g.r, w.lang) x ON x.r = q.r AND x.lang = s.lang))) WHERE nth = 1"""


PARTS["said_rows"] = "SELECT conv_id || ':' || turn AS r, conv_id, turn, text, NULL AS lang FROM conversations WHERE role = 'user'"
PARTS["said_grams"] = _trigrams_sql("said_rows", "conv_id")
PARTS["said_lang"] = _best_sql("said_rows", "said_grams", "r, conv_id, turn")


def language_model_of(spark: SparkSession, sf_dir: str) -> language_model.Model:
    return language_model.learned(_docs(spark, sf_dir).where(f"NOT ({HELD_OUT.format('cast(doc_id AS string)')})"))


@query(_best_sql("lang_rows", "lang_grams", "doc_id, held_out"))
def language_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by the model, which learns from three quarters of them."""
    rows = _docs(spark, sf_dir).select("doc_id", F.expr(HELD_OUT.format("cast(doc_id AS string)")).alias("held_out"), "text")
    return language_model.identified(rows, language_model_of(spark, sf_dir))


@query(rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[\x{{0C00}}-\x{{0C7F}}]') THEN 'Telugu'
WHEN list_has_any(regexp_extract_all(lower(text), '{T}'), [{_ROMAN}]) THEN 'Telugu' ELSE predicted END AS language FROM said_rows JOIN said_lang USING (r, conv_id, turn)""")
def detect_language_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By script, then by romanised words, then by the model."""
    said = _asked(spark, sf_dir).select("conv_id", "turn", "text", understand.language(F.col("text"), F.lit(None)).alias("sure"))
    found = language_model.identified(said, language_model_of(spark, sf_dir))
    return found.select("conv_id", "turn", F.coalesce("sure", "predicted").alias("language"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'")


ROUTE_SQL = rf"""CASE WHEN {_any("lower(text)", understand.LEGAL)} THEN 'rag'
WHEN ({_any("lower(text)", understand.GREETINGS)} OR regexp_matches(text, '{"|".join(understand.GREETINGS_IN_SCRIPT)}'))
AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 40 THEN 'general_chat' ELSE 'rag' END"""


@query(f"SELECT conv_id, turn, {ROUTE_SQL} AS route FROM conversations WHERE role = 'user'")
def route_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", understand.route(F.col("text")).alias("route"))


TYPE_SQL = f"CASE WHEN regexp_matches(lower(text), '{'|'.join(understand.EXPLANATORY)}') THEN 'explanatory' ELSE 'factual' END"


@query(f"SELECT conv_id, turn, {TYPE_SQL} AS type FROM conversations WHERE role = 'user'")
def query_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", understand.query_type(F.col("text")).alias("type"))


# RE2 has no look-around: every token is put between marks, which stand for the word boundaries.
_MARKED = f"regexp_replace(text, '({T})', chr(1) || '\\1' || chr(2), 'g')"
TERMS_SQL = f"""list_sort(list_distinct(list_transform(list_concat(list_concat(regexp_extract_all({_MARKED}, '\\x01[A-Z]{{2,}}\\x02'),
regexp_extract_all({_MARKED}, '\\x01[A-Z][a-z]+\\x02(?:{W}+\\x01[A-Z][a-z]+\\x02)+')), regexp_extract_all({_MARKED}, '\\x01[A-Z][a-z]{{2,}}\\x02')),
lambda x: lower(translate(x, chr(1) || chr(2), '')))))"""


@query(f"SELECT item_id AS query_id, array_to_string({TERMS_SQL}, ',') AS terms FROM benchmark")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(text.key_terms(F.col("text")), ",").alias("terms"))


EXPAND_SQL = f"""SELECT query_id, generate_subscripts(x, 1) - 1 AS sub_query, unnest(x) AS text FROM (
SELECT item_id AS query_id, CASE WHEN len({TERMS_SQL}) = 0 THEN [text] ELSE [array_to_string({TERMS_SQL}, ' '), text] END AS x FROM benchmark)"""


@query(EXPAND_SQL)
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(understand.expanded(F.col("text"))).alias("sub_query", "text")).select(
        "query_id", F.col("sub_query").cast("long").alias("sub_query"), "text"
    )
