import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from deskweave.functions import responses as R
from deskweave.functions import text as X
from deskweave.functions import words as W
from deskweave.functions.html import html_text, html_text_exact
from deskweave.functions.nested import normalised_nested
from deskweave.sources.tables import table


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(column.alias("r")).first()["r"]


def test_normalised_text_and_lists(spark):
    assert one(spark, X.normalised("a"), a="  Straße \t NORD ") == "strasse nord"
    assert one(spark, X.equal_after_normalising("a", "b"), a='["VPN", "Net  work"]', b='["net work","vpn"]')
    assert not one(spark, X.equal_after_normalising("a", "b"), a='["x","x"]', b='["x"]')
    assert not one(spark, X.equal_after_normalising("a", "b"), a=None, b=None)
    assert one(spark, X.equal_after_normalising("a", "b"), a="[broken", b=" [BROKEN ")


def test_tokens(spark):
    assert one(spark, X.tokens("a"), a="How do I fix the VPN-client v1.2_x, ok? é1a b") == ["do", "fix", "vpn-client", "v1.2_x", "ok", "1a"]


def test_response_forms(spark):
    plain, inner = '{"tier":"L2","quality":"1"}', '{"prediction":{"quality":" 0 ","toxic":null}}'
    for text, quality, level in (
        (plain, "1", "L2"), (f"```json\n{plain}\n```", "1", "L2"), (f"```JSON {plain} ```", "1", "L2"), (f"Sure: {plain}. Done", "1", "L2"),
        (inner, " 0 ", None), ("no answer", None, None), ('["x"]', None, None), ("", None, None), (None, None, None),
    ):
        got = one(spark, F.struct(R.response_field(R.prediction_object("a"), "quality").alias("q"), R.response_field(R.prediction_object("a"), "support_level").alias("l")), a=text)
        assert (got["q"], got["l"]) == (quality, level), text


def test_record_array_keeps_objects(spark):
    count = F.size(R.record_array("a", "records"))
    assert one(spark, count, a='{"records":[{"a":1},"x",{"b":2}]}') == 2
    assert one(spark, count, a='```json\n[{"a":1}]\n```') == 1


def test_bar_rounds_half_to_even(spark):
    assert one(spark, X.bar("a"), a=0.5) == "█" * 6 + "░" * 6
    assert one(spark, X.bar("a"), a=2.5 / 12) == "█" * 2 + "░" * 10
    assert one(spark, X.percent("a"), a=0.1234) == "12.3%"


def test_slug_role_and_mail(spark):
    assert one(spark, X.slug("a"), a="__Net/Work  Été 7!") == "net_work_été_7"
    assert one(spark, X.chat_role("a"), a="Machine") == "assistant"
    assert one(spark, X.redact_email("a"), a="to Bob.x+1@Mail.example.COM now") == "to [REDACTED_EMAIL] now"


def test_sections(spark):
    assert one(spark, X.sections("a"), a="intro\n# One\ntext\n\n\n\nmore\n#### deep\n## Two") == ["intro", "# One\ntext", "more\n#### deep", "## Two"]
    assert one(spark, X.sections("a"), a="  ") == ["  "]


def test_html_forms_agree_on_all_pages(spark):
    page = "<p>Refresh the approved VPN profile.</p>"
    assert one(spark, html_text("a"), a=page) == one(spark, html_text_exact("a"), a=page) == "Refresh the approved VPN profile."
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    differing = pages.where(html_text("html") != html_text_exact("html"))
    assert differing.count() == 0


def test_nested_values(spark):
    df = spark.sql("""SELECT named_struct('b', array('Y', ' x '), 'a', 1) AS s, named_struct('a', 1, 'b', array('x', 'y')) AS t,
        parse_json('{"k": ["B", null, "a"], "n": 1.0}') AS v, parse_json('{"n": 1, "k": ["a", "b"]}') AS w""")
    row = df.select((normalised_nested("s") == normalised_nested("t")).alias("st"), (normalised_nested("v") == normalised_nested("w")).alias("vw"),
                    X.equal_after_normalising("v", "w", "variant").alias("eq"), X.equal_after_normalising("v", F.lit(None).cast("variant"), "variant").alias("none")).first()
    assert tuple(row) == (True, True, True, False)


def test_native_page_text_equals_the_parser(spark):
    from deskweave.functions.html import html_text, html_text_exact

    pages = ["Caf&eacute; &#8217; x", "<a title=\"a>b\">c</a>", "<p>a<p>b &amp;lt; c", "&notit; &ampx &unknown; &Aacutexx &#x2019 &#128; &#129; &#1; &#xFFFFFFFFFFFFF; &#0; &NotEqualTilde;",
             "<script a='>'>var x='</p>';</script>z", "<div class='x>y'>q</div><!-- > -->r", "a &lt;b&gt;c&lt;/b&gt; d", "", None]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, t string")
    for r in rows.select("t", html_text("t").alias("native"), html_text_exact("t").alias("exact")).collect():
        assert (r["native"] or "") == r["exact"], r["t"]


def test_vocabulary_counts_are_those_of_the_tokens(spark, monkeypatch):
    texts = ["", "a", "..a", "..ab c. -x_y the the", "é1a b İX-9 K9", "x" * 40 + " ab", "-._", "ab", "ab", "9_ 9_ ß9.z\u00009q the", "日本ab語cd"]
    random = np.random.default_rng(3)
    texts += ["".join(random.choice(list("aB9._- éthe\n"), 30)) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    tokens = {r["i"]: r["w"] for r in rows.select("i", X.tokens("t").alias("w")).collect()}
    vocabulary = sorted({w for ws in tokens.values() for w in ws})[::2] + ["nowhere"]
    want = {(i, len(ws), w, ws.count(w)) for i, ws in tokens.items() for w in set(ws) & set(vocabulary)} | {(i, len(ws), "!", 1) for i, ws in tokens.items()}
    lowered = rows.select("i", F.lower("t").alias("t")).toArrow().combine_chunks()
    for step in (16, 1 << 20):
        monkeypatch.setattr(W, "STEP_BYTES", step)
        got = [tuple(r.values()) for b in W.vocabulary_counts(iter(lowered.to_batches(max_chunksize=50)), "t", ["i"], vocabulary, "!") for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want
    assert not list(W.vocabulary_counts(iter([pa.record_batch({"i": pa.array([], pa.int64()), "t": pa.array([], pa.string())})]), "t", ["i"], vocabulary, "!"))
