"""More named queries with their SQL side by side: detectors in combination, span checks, redaction forms, loaders, states and studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U8
from ..operators import context as X
from ..operators import detect as D
from ..operators import generate as N
from ..operators import ordered as O
from ..operators import redact as R
from ..operators import report as G
from ..operators import score as Q
from ..operators import sections as C
from ..operators import spans as S
from ..operators import study as U
from ..sources import loaders as L
from ..sources import office as W
from . import catalog as K
from . import memos as M
from . import oracle as A

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


MEMO = f"WITH {M.MEMO_SQL}"
MASKED = (
    "masked AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\b[ABCDEFGHIJKLMNOPRSTUVXYZ]{3}-\\d{3}\\b', '███████', 'g'), "
    "'\\bINV-\\d{5}\\b', '█████████', 'g'), '\\b\\d{6}[-+A]\\d{3}[0-9ABCDEFHJKLMNPRSTUVWXY]\\b', '███████████', 'g') AS text FROM memo)"
)


@query(f"{MEMO}, {MASKED} SELECT * FROM ({A.spans('memo', A.PROJECT)}) UNION ALL SELECT * FROM ({A.spans('masked', A.WIDE)})")
def final_pass(spark, sf_dir):
    memo = M.memos(spark, sf_dir).select("doc_id", "text")
    return K.long(D.final_pass(memo, D.pattern_spans(memo), lambda d: D.pattern_spans(d, K.WIDE)))


@query(f"{MEMO} SELECT * FROM ({A.spans('memo', A.PROJECT)}) UNION ALL SELECT * FROM ({A.spans('memo', A.PROJECT)}) UNION ALL SELECT * FROM ({A.spans('memo', A.WIDE)})")
def union_spans(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    once = D.pattern_spans(memo)
    return K.long(D.union(once, once, D.pattern_spans(memo, K.WIDE)))


@query(f"""WITH {M.CONTEXT_SQL}, listed AS (SELECT doc_id, s1 AS s, e1 AS e, t1 AS kind, stays1 AS stays FROM context_doc UNION ALL SELECT doc_id, s2, e2, t2, stays2 FROM context_doc)
SELECT doc_id, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", kind AS entity_type, CAST(0.9 AS DOUBLE) AS score FROM listed WHERE stays UNION ALL SELECT * FROM ({A.spans('context_doc', A.BUSINESS)})""")
def combined_detectors(spark, sf_dir):
    docs, spans = M.context_cases(spark, sf_dir)
    owned = F.col("entity_type").isin("PERSON", "ORGANIZATION", "LOCATION")
    # the rules' own names give way to the model's
    return K.long(X.combined(docs, spans.unionByName(spans.filter(owned).withColumn("end", F.col("end") + 1)), spans.filter(owned)))


@query(f"{MEMO} SELECT DISTINCT * FROM ({A.spans('memo', A.PROJECT)})")
def long_text_spans(spark, sf_dir):
    return K.long(D.detect_long(M.memos(spark, sf_dir).select("doc_id", "text"), D.pattern_spans, limit=150, overlap=60))


@query(f"""{MEMO} SELECT entity_type, CAST(count(*) FILTER (WHERE doc_id % 5 = 4) AS BIGINT) AS valid, CAST(count(*) FILTER (WHERE doc_id % 5 < 4) AS BIGINT) AS rejected FROM ({A.spans('memo', A.PROJECT)}) GROUP BY ALL""")
def validated_spans(spark, sf_dir):
    memo, k = M.memos(spark, sf_dir), F.col("doc_id") % 5
    spans = D.pattern_spans(memo).withColumn("end", F.when(k == 0, F.col("start")).when(k == 1, 1_000_000).otherwise(F.col("end"))).withColumn("score", F.when(k == 2, 1.5).when(k == 3, float("nan")).otherwise(F.col("score")))
    good, bad = S.validate(spans, memo)
    return good.select("entity_type", F.lit(1).alias("v")).unionByName(bad.select("entity_type", F.lit(0).alias("v"))).groupBy("entity_type").agg(F.count_if(F.col("v") == 1).alias("valid"), F.count_if(F.col("v") == 0).alias("rejected"))


@query(f"""SELECT doc_id, idx, text FROM ({A.SQL['word_layout']}) WHERE "start" < 9 AND "end" > 4""")
def words_in_spans(spark, sf_dir):
    laid = R.layout(K._words(spark, sf_dir))
    spans = laid.select("doc_id", F.lit(4).alias("start"), F.lit(9).alias("end")).distinct()
    return K.long(R.words_in_spans(laid, spans).select("doc_id", "idx", "text"))


@query(f"""{MEMO} SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\b[ABCDEFGHIJKLMNOPRSTUVXYZ]{{3}}-\\d{{3}}\\b', '[PLATE]', 'g'), '\\bINV-\\d{{5}}\\b', '[INVOICE]', 'g'), '\\b\\d{{6}}[-+A]\\d{{3}}[0-9ABCDEFHJKLMNPRSTUVWXY]\\b', '[PERSONAL_ID]', 'g')) AS text_md5 FROM memo""")
def anonymised_text(spark, sf_dir):
    clean, _ = R.anonymise(M.memos(spark, sf_dir).select("doc_id", "text"), D.pattern_spans)
    return clean.select("doc_id", F.md5("text").alias("text_md5"))


@query(f"{MEMO} SELECT doc_id, md5(" + "replace(" * len(M.LABELS) + "text" + "".join(f", {c}, '[{t}]')" for t, c, _ in M.LABELS) + ") AS text_md5 FROM memo")
def replaced_values(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    values = M.labels(memo).select("doc_id", "value", F.col("type").alias("entity_type"))
    return R.replace_values(memo.select("doc_id", "text"), values).select("doc_id", F.md5("text").alias("text_md5"))


@query("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 3 WHEN 0 THEN 'PERSONAL_ID' WHEN 1 THEN 'FI_EMAIL2' ELSE 'NAME' END AS k, lpad(CAST(p_partkey * 7919 % 10000000 AS STRING), 7, '0') AS d FROM part),
c AS (SELECT *, (CAST(d[1] AS INT) * 7 + CAST(d[2] AS INT) * 9 + CAST(d[3] AS INT) * 10 + CAST(d[4] AS INT) * 5 + CAST(d[5] AS INT) * 8 + CAST(d[6] AS INT) * 4 + CAST(d[7] AS INT) * 2) % 11 AS r FROM p)
SELECT id, CASE k WHEN 'FI_EMAIL2' THEN 'EMAIL' ELSE k END AS label_type, CAST(CASE WHEN r = 0 THEN 0 WHEN r > 1 THEN 11 - r END AS BIGINT) AS check_digit, id % 4 = 0 AS loopback,
  CASE WHEN id % 2 = 0 THEN '1,2,3' END AS selection, CAST(id // 2 AS BIGINT) AS "left", CAST((id + 7 + 1) // 2 - id // 2 AS BIGINT) AS width, CAST(id % 30 - greatest(3, id // 3) AS BIGINT) AS box_left FROM c""")
def small_functions(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    key = F.when(k % 3 == 0, "PERSONAL_ID").when(k % 3 == 1, "FI_EMAIL2").otherwise("NAME")
    url = F.when(k % 4 == 0, "http://127.0.0.1:8080/v1").when(k % 4 == 1, "https://127.0.0.1/v1").when(k % 4 == 2, "http://a@127.0.0.1/v1").otherwise("http://10.0.0.1/v1")
    picked = R.valid_selection(F.array(F.lit(3), F.lit(1), F.lit(2), F.lit(1)), F.when(k % 2 == 0, 4).otherwise(3))
    box, grown = T.unscale_box(k, k, F.lit(7), F.lit(7), 2), T.expand_box(k % 30, k, k, k)
    rows = K.read(spark, sf_dir, "part").select(k.alias("id"), T.label_type(key).alias("label_type"), T.business_check_digit(F.lpad((k * 7919 % 10_000_000).cast("string"), 7, "0")).cast("long").alias("check_digit"),
        T.is_loopback_endpoint(url).alias("loopback"), F.array_join(picked, ",").alias("selection"), box["left"].cast("long").alias("left"), box["width"].cast("long").alias("width"), grown["left"].cast("long").alias("box_left"))
    return rows


@query(f"""{MEMO}, cut AS (SELECT doc_id, string_split(text, chr(10) || '## ') AS a FROM memo)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS n, CASE i WHEN 1 THEN '(start)' ELSE split_part(a[i], chr(10), 1) END AS title,
  md5(CASE i WHEN 1 THEN a[i] ELSE substr(a[i], length(split_part(a[i], chr(10), 1)) + 2) END || CASE WHEN i < len(a) THEN chr(10) ELSE '' END) AS body_md5 FROM cut, unnest(range(1, len(a) + 1)) AS u(i)""")
def text_sections(spark, sf_dir):
    return K.long(C.split_sections(M.memos(spark, sf_dir)).select("doc_id", "n", "title", F.md5("body").alias("body_md5")))


@query("""SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 3 > 0 THEN '## Document metadata' || chr(10) || chr(10) || '- title: ' || p_name || ' ## x' || CASE WHEN p_partkey % 3 = 2 THEN chr(10) || '- author: ' || p_brand ELSE '' END END AS section FROM part""")
def metadata_sections(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    listed = F.array(pair("title", F.when(k % 3 > 0, F.concat("p_name", F.lit(" \n ## x\n")))), pair("empty", F.lit(" \n")), pair("author", F.when(k % 3 == 2, F.col("p_brand"))))
    return K.read(spark, sf_dir, "part").select(k.alias("id"), T.metadata_section(listed).alias("section"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 4 < 2 THEN 'full' WHEN p_partkey % 4 = 2 THEN 'partial' ELSE 'missed' END AS piece_state, CASE p_partkey % 4 WHEN 0 THEN 'full' WHEN 3 THEN 'missed' ELSE 'partial' END AS quote_state,
  CASE p_partkey % 6 WHEN 0 THEN 'invalid' WHEN 1 THEN 'refused' WHEN 2 THEN 'invalid' WHEN 3 THEN 'invalid' WHEN 4 THEN 'correct' ELSE 'wrong' END AS answer_state,
  CASE p_partkey % 4 WHEN 0 THEN 'unread' WHEN 1 THEN 'leaked' WHEN 2 THEN 'hidden' ELSE 'partial' END AS image_state, CASE p_partkey % 3 WHEN 0 THEN 'absent' WHEN 1 THEN 'missed' ELSE 'covered' END AS display_state FROM part""")
def scoring_states(spark, sf_dir):
    k, v = F.col("p_partkey").cast("long"), F.col("p_name")
    head, tail = F.substring(v, 1, 5), v.substr(F.lit(6), F.length(v))
    pieces = F.when(k % 4 == 0, F.array(F.concat(v, F.lit("x")))).when(k % 4 == 1, F.array(head, tail)).when(k % 4 == 2, F.array(head)).otherwise(F.array(F.lit("###")))
    quotes = F.when(k % 4 == 0, F.array(F.concat(v, F.lit("x")))).when(k % 4 < 3, F.array(head)).otherwise(F.array(F.lit("##")))
    refused = F.when(k % 6 == 0, None).otherwise(k % 6 < 3)
    answer = F.when(k % 6 == 1, " ").when(k % 6 == 3, "").when(k % 6 == 5, "other").otherwise(v)
    image = Q.image_state(k % 4 > 0, k % 4 == 1, F.when(k % 4 == 1, 0).when(k % 4 == 2, 5).otherwise(2), F.lit(5))
    shown = Q.display_state(k % 3 > 0, F.when(k % 3 == 1, "").otherwise("covered"))
    return K.read(spark, sf_dir, "part").select(k.alias("id"), Q.piece_state(v, pieces).alias("piece_state"), Q.quote_state(v, quotes).alias("quote_state"), Q.answer_state(answer, refused, F.array(v)).alias("answer_state"), image.alias("image_state"), shown.alias("display_state"))


SCORES = ("correct", "wrong", "refused", "invalid", "unanswered")
ANSWERED = """scored AS (SELECT o_orderpriority AS variant, o_orderkey % 7 = 0 AS unanswered, CASE WHEN o_orderkey % 7 = 0 THEN 'unanswered' WHEN o_orderkey % 5 = 0 THEN 'refused' WHEN o_orderkey % 3 = 0 THEN 'wrong' ELSE 'correct' END AS score, o_orderkey AS request_id FROM orders)"""


def _scored(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    orders = K.read(spark, sf_dir, "orders")
    requests = orders.select(k.alias("request_id"), F.col("o_orderpriority").alias("variant"), F.array(F.lit("yes"), F.lit("oui")).alias("ground_truth"))
    refused = k % 5 == 0
    answers = orders.filter(k % 7 > 0).select(k.alias("request_id"), F.when(refused, "").when(k % 3 == 0, "no").otherwise("oui").alias("answer"), refused.alias("refused"), F.lit("m").alias("model"))
    return U.score_recorded(requests, answers)


@query(f"WITH {ANSWERED} SELECT CAST(request_id AS BIGINT) AS request_id, score FROM scored")
def recorded_answers(spark, sf_dir):
    return _scored(spark, sf_dir).select("request_id", "score")


@query(f"WITH {ANSWERED} SELECT variant, " + ", ".join(f"CAST(count(*) FILTER (WHERE score = '{s}') AS BIGINT) AS {s}" for s in SCORES) + ", CAST(count(*) AS BIGINT) AS requests, count(*) FILTER (WHERE score = 'correct') / CAST(count(*) AS DOUBLE) AS correct_rate FROM scored GROUP BY ALL")
def study_summary(spark, sf_dir):
    return G.score_pivot(_scored(spark, sf_dir), ["variant"])


@query(f"{MEMO} {A.spans('memo', A.PROJECT)}")
def replayed_spans(spark, sf_dir):
    memo = M.memos(spark, sf_dir).select("doc_id", "text")
    found = D.pattern_spans(memo).join(memo.select("doc_id", F.sha2("text", 256).alias("text_sha256")), "doc_id").drop("doc_id")
    empty = memo.select(*(F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c != "text_sha256"), F.sha2("text", 256).alias("text_sha256"))
    return K.long(L.replay(memo, found, empty))


MENTIONED = "one AS (SELECT lpad(CAST(o_orderkey AS STRING), 12, '0') AS doc_id, row_number() OVER (ORDER BY o_orderkey) AS r, o_orderkey AS k FROM orders), kept AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM one WHERE (r - 1) % 3 = 0 QUALIFY n <= 40)"


@query(f"WITH {MENTIONED} SELECT doc_id, CAST(CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS mentions, CAST(3 AS BIGINT) AS annotated, CASE WHEN k % 2 = 0 THEN 'ADDRESS' ELSE 'PERSON' END AS first_type FROM kept")
def court_loader(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    mention = lambda s, e, t, i: F.struct(F.lit(s).alias("start_offset"), F.lit(e).alias("end_offset"), t.alias("entity_type"), i.alias("identifier_type"))
    quasi, even = F.lit("QUASI"), k % 2 == 0
    # the range 0-4 is given twice and the last counts; NO_MASK is no mention but annotated; the second annotator doesn't count
    mine = F.array(mention(0, 4, F.lit("ORG"), quasi), mention(5, 9, F.lit("CODE"), F.when(even, "NO_MASK").otherwise("DIRECT")), mention(10, 12, F.lit("UNKNOWN"), quasi), mention(0, 4, F.when(even, "LOC").otherwise("PERSON"), quasi))
    noted = F.create_map(F.lit("b"), F.struct(F.array(mention(1, 2, F.lit("ORG"), quasi)).alias("entity_mentions")), F.lit("a"), F.struct(mine.alias("entity_mentions")))
    records = K.read(spark, sf_dir, "orders").select(F.lpad(k.cast("string"), 12, "0").alias("doc_id"), F.lit("some text here").alias("text"), noted.alias("annotations"))
    return L.court(records).select("doc_id", F.size("mentions").cast("long").alias("mentions"), F.size("annotated").cast("long").alias("annotated"), F.col("mentions")[0]["type"].alias("first_type"))


@query("""WITH f AS (SELECT CAST(o_orderkey AS BIGINT) AS doc_id, 1 + o_orderkey % 3 AS lines FROM orders), r AS (SELECT *, coalesce(sum(lines) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT doc_id, 'PERSON' AS type, CAST(0 AS BIGINT) AS "start", CAST(3 AS BIGINT) AS "end", CAST(2 AS BIGINT) AS annotated FROM r WHERE before < 300""")
def standoff_loader(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    lines = F.array_join(F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.concat(F.lit("Ann line "), i.cast("string"))), "\n\n")
    files = K.read(spark, sf_dir, "orders").select(k.alias("doc_id"), lines.alias("text"), F.lit("T1\tPER 0 3\tAnn\nR1\trel\nT2\tFOO 4 8\tline\n").alias("ann"))
    found = L.standoff(files)
    return K.long(found.select("doc_id", F.explode("mentions").alias("m"), F.size("annotated").alias("annotated")).select("doc_id", "m.type", "m.start", "m.end", "annotated"))


@query("""SELECT CAST(p_partkey AS STRING) AS doc_id, p_name AS text, CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'fi' END AS language, 'PERSON' AS type, CAST(0 AS BIGINT) AS "start", CAST(2 AS BIGINT) AS "end", CAST(2 AS BIGINT) AS annotated FROM part""")
def pii_loader(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    mask = F.array(F.struct(F.lit("SURNAME").alias("label"), F.lit(0).alias("start"), F.lit(2).alias("end")), F.struct(F.lit("TITLE").alias("label"), F.lit(2).alias("start"), F.lit(3).alias("end")))
    records = K.read(spark, sf_dir, "part").select(k.cast("string").alias("uid"), F.col("p_name").alias("source_text"), F.when(k % 2 == 0, "en").otherwise("fi").alias("language"), mask.alias("privacy_mask"))
    found = L.pii(records, rows=1_000_000_000)
    return K.long(found.select("doc_id", "text", "language", F.explode("mentions").alias("m"), F.size("annotated").alias("annotated")).select("doc_id", "text", "language", "m.type", "m.start", "m.end", "annotated"))


@query("SELECT doc_id, md5(substr(text, 1, 50)) AS text_md5 FROM documents")
def truncated_documents(spark, sf_dir):
    return L.truncated(K.documents(spark, sf_dir), 50).select("doc_id", F.md5("text").alias("text_md5"))


@query("""SELECT id, text, type, value, CAST("start" AS BIGINT) AS "start", CAST("start" + length(value) AS BIGINT) AS "end" FROM (SELECT CAST(p_partkey AS BIGINT) AS id, 'Part ' || p_name || ' of ' || p_brand || '.' AS text,
  unnest([{'type': 'NAME', 'value': p_name, 'start': 5}, {'type': 'BRAND', 'value': p_brand, 'start': 9 + length(p_name)}], recursive := true) FROM part)""")
def rendered_labels(spark, sf_dir):
    rows = K.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("NAME"), F.col("p_brand").alias("BRAND"))
    return K.long(N.render(rows, "Part {{NAME}} of {{BRAND}}.").select("id", "text", F.explode("labels").alias("l")).select("id", "text", "l.*"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS id, unnest(CASE p_partkey % 3 WHEN 1 THEN ['offsets'] WHEN 2 THEN ['unlabelled repeat'] ELSE [] END) AS problem FROM part""")
def label_problems(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    label = F.struct(F.lit("A").alias("type"), F.lit("#1#").alias("value"), F.when(k % 3 == 1, 1).otherwise(0).alias("start"), F.when(k % 3 == 1, 4).otherwise(3).alias("end"))
    docs = K.read(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 == 2, "#1# and #1#").otherwise("#1# and").alias("text"), F.array(label).alias("labels"))
    return N.problems(docs)


LEAVES = "d AS (SELECT row_number() OVER (ORDER BY doc_id, sha256(coalesce(lang, '') || chr(0) || coalesce(text, ''))) - 1 AS k, sha256(coalesce(lang, '') || chr(0) || coalesce(text, '')) AS h FROM documents)"


@query(f"WITH {LEAVES}, a AS (SELECT k // 1000 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM d GROUP BY 1), b AS (SELECT k // 1000 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM a GROUP BY 1), c AS (SELECT k // 1000 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM b GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY k)) AS fingerprint FROM c")
def corpus_fingerprint(spark, sf_dir):
    return O.fingerprint(K.documents(spark, sf_dir), "doc_id", "lang", "text")


@query(f"{MEMO} SELECT doc_id, md5(replace(text, '## Document metadata' || chr(10) || '- author: ' || author || chr(10) || chr(10), '')) AS text_md5 FROM memo")
def text_without_metadata(spark, sf_dir):
    return M.memos(spark, sf_dir).select("doc_id", F.md5(U8.remove_document_metadata("text")).alias("text_md5"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS id, trim(regexp_replace(p_name || ' ' || p_type || ' Å|x', '\\s+', ' ', 'g')) AS layout, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS answer, lower(replace(p_name, ' ', '')) || 'å' AS compat FROM part""")
def normalised_values(spark, sf_dir):
    k, decomposed = F.col("p_partkey").cast("long").alias("id"), "Å"
    layout = F.concat(F.lit(" "), "p_name", F.lit("<br>\n"), "p_type", F.lit(f"  {decomposed}\\|x\t"))
    answer = F.concat(F.lit('"'), F.upper("p_name"), F.lit('."'))
    rows = K.read(spark, sf_dir, "part").select(k, layout.alias("a"), answer.alias("b"), F.concat(F.upper("p_name"), F.lit(f" Å")).alias("c"))
    return rows.select("id", U8.normalize_layout("a").alias("layout"), U8.normalize_answer("b").alias("answer"), U8.normalize_compat("c").alias("compat"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS id, unnest(CASE WHEN p_partkey % 2 = 0 THEN [p_name, p_brand] ELSE [p_name] END) AS value FROM part""")
def visible_labels(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" of ", "p_name", "p_brand")).otherwise(F.col("p_name"))
    rows = K.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), text.alias("text"), F.col("p_name").alias("NAME"), F.col("p_name").alias("AGAIN"), F.col("p_brand").alias("BRAND"))
    return N.visible_labels(rows, ["NAME", "BRAND"]).select("id", "value")


def _office_file(kind: str, name: str) -> bytes:
    """A small file of each format that holds a name."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    if kind in ("txt", "md"):
        return b"\xef\xbb\xbf" + name.encode()
    if kind == "csv":
        return f'a,b\n"{name}|",\n1'.encode()
    if kind not in ("docx", "xlsx", "pptx"):
        return b""
    name, rel = escape(name), "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet, show, word = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"', "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    link = lambda target: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="{target}" Type="x"/></Relationships>'
    shape = lambda t, title: f'<p:sp>{"<p:nvSpPr><p:nvPr><p:ph type=\'title\'/></p:nvPr></p:nvSpPr>" if title else ""}<p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    parts = {
        "docx": {"word/document.xml": f'<w:document xmlns:w="{word}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>{name}</w:t></w:r></w:p></w:body></w:document>'},
        "xlsx": {
            "xl/workbook.xml": f'<workbook xmlns="{sheet}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": link("worksheets/sheet1.xml"),
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{sheet}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{name}</t></is></c><c r="B1"><v>5</v></c></row></sheetData></worksheet>',
        },
        "pptx": {
            "ppt/presentation.xml": f'<p:presentation {show} xmlns:r="{rel}"><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": link("slides/slide1.xml"),
            "ppt/slides/slide1.xml": f"<p:sld {show}><p:cSld><p:spTree>{shape('Head', True)}{shape(name, False)}</p:spTree></p:cSld></p:sld>",
        },
    }[kind]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, xml in parts.items():
            z.writestr(path, xml)
    return out.getvalue()


@query("""WITH f AS (SELECT *, list_value('txt', 'md', 'csv', 'docx', 'xlsx', 'pptx', 'pdf', 'zip')[CAST(p_partkey % 8 AS INT) + 1] AS kind FROM part)
SELECT 'files/' || CAST(p_partkey AS STRING) || '.' || kind AS path, kind AS format, CASE kind WHEN 'txt' THEN p_name WHEN 'md' THEN p_name WHEN 'csv' THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || chr(92) || '| |  |' || chr(10) || '| 1 |  |'
  WHEN 'docx' THEN '## Document content' || chr(10) || chr(10) || '# Head' || chr(10) || chr(10) || p_name WHEN 'xlsx' THEN '## Sheet: One' || chr(10) || chr(10) || '| ' || p_name || ' | 5 |' || chr(10) || '| --- | --- |' WHEN 'pptx' THEN '## Slide 1: Head' || chr(10) || chr(10) || p_name END AS text,
  CASE WHEN kind IN ('pdf', 'zip') THEN 'UnsupportedFormat' END AS error FROM f""")
def extracted_files(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("txt", "md", "csv", "docx", "xlsx", "pptx", "pdf", "zip"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    content = F.udf(_office_file, "binary")(kind, F.col("p_name"))
    files = M.dealt(K.read(spark, sf_dir, "part"), "p_partkey").select(F.concat(F.lit("files/"), F.col("p_partkey").cast("string"), F.lit("."), kind).alias("path"), content.alias("content")).withColumn("length", F.length("content").cast("long"))
    return W.extract_files(files).select("path", "format", "text", F.substring_index("error", ":", 1).alias("error"))
