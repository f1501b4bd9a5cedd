import random
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quietlake import queries
from quietlake.functions import redact
from quietlake.functions.flatten import html_text, html_to_text
from quietlake.functions.globs import Globs, to_regex
from quietlake.functions.lines import lines
from quietlake.sources import blobs

_rng = random.Random(41)


def _digits(n: int) -> str:
    return "".join(_rng.choice("123456789") for _ in range(n))


def _letters(n: int) -> str:
    return "".join(_rng.choice("bcdfghkmpqrstvwxz") for _ in range(n))


def cases():
    """For every pattern values of its shape between words, as (text, value, kind)."""
    made = (
        ("US_SSN", lambda: f"{_digits(3)}-{_digits(2)}-{_digits(4)}", "form {} filed"),
        ("US_SSN", lambda: _digits(9), "{} (his SSN)"),
        ("PHONE_NUMBER", lambda: f"({_digits(3)}) {_digits(3)}-{_digits(4)}", "ring {} today"),
        ("PHONE_NUMBER", lambda: f"+1 {_digits(3)}.{_digits(3)}.{_digits(4)}", "or {}"),
        ("EMAIL_ADDRESS", lambda: f"{_letters(5)}+{_letters(2)}@{_letters(6)}.{_letters(3)}", "to {} now"),
        ("RECORD_NUMBER", lambda: f"account no: {_digits(7)}", "see {}."),
        ("RECORD_NUMBER", lambda: f"Contact Serial {_digits(9)}", "{}"),
        ("IP_ADDRESS", lambda: ".".join(_digits(2) for _ in range(4)), "from {} in"),
        ("CREDIT_CARD", lambda: " ".join(_digits(4) for _ in range(4)), "paid by {}."),
        ("TOKEN", lambda: "gho_" + _letters(24), "x {} y"),
        ("TOKEN", lambda: "dapi" + "".join(_rng.choice("0123456789abcdef") for _ in range(26)), "use {}"),
        ("TOKEN", lambda: "lin_api_" + _letters(12) + _digits(12), "use {}"),
        ("TOKEN", lambda: f"passwd: '{_letters(10)}-{_digits(8)}", "its {}' is"),
    )
    return [(form.format(value), value, kind) for kind, make, form in made for value in (make(), make())]


CASES = cases()
FOUND = [(text, kind) for text, _, kind in CASES]
KEPT = ["a walk of 12 km", "in 2031-04", "release 4.7.1", "room 20418", "3,650 votes", "x@y", "the tokens of a text", "paths and patterns"]


def chain(text):
    """The same chain in Python."""
    kinds = set()
    for kind, p in redact.PATTERNS:
        text, n = re.subn(p, redact.LABEL.format(kind), text)
        kinds |= {kind} if n else set()
    return text, sorted(kinds)


def both(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [(r[0], r[1]) for r in df.orderBy("i").select(redact.redact(F.col("t")), redact.redact_kinds(F.col("t"))).collect()]


def test_found_and_kept(spark):
    got = both(spark, [t for t, *_ in CASES] + KEPT)
    for (text, value, kind), (clean, kinds) in zip(CASES, got, strict=False):
        assert kind in kinds and f"<REDACTED:{kind}>" in clean and value not in clean, text
    for text, (clean, kinds) in zip(KEPT, got[len(CASES) :], strict=True):
        assert (clean, kinds) == (text, [])


def test_digits_and_letters_of_any_script(spark):
    (a, x), (b, y) = both(spark, ["n. ١٢٣-٤٥-٦٧٨٩", "à élodie@café.fr"])
    assert (x, y) == (["US_SSN"], ["EMAIL_ADDRESS"]) and "٤٥" not in a and "élodie" not in b


def test_staged_chain_is_the_nested_one(spark):
    texts = [t for t, *_ in CASES] + KEPT + [" ".join(t for t, *_ in CASES), "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    n = redact.staged_kinds()
    got = redact.staged(df, "t").orderBy("i").select("_text", *[n[k].alias(k) for k in n])
    want = df.select("i", redact.hit_counts(F.col("t")).alias("h")).orderBy("i")
    m = redact.kind_counts(F.col("h"))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.select("h.text", *[m[k] for k in n]).collect()]


def test_scan_runs_each_pattern_once(spark):
    """Catalyst neither puts the steps of the chain into each other nor repeats them in a filter."""
    df = spark.createDataFrame([("p", "x 10.0.0.1")], "path string, text string")
    plan = blobs.scan_lines(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= len(redact.PATTERNS) + 1 and plan.count("regexp_count(") <= len(redact.PATTERNS) and "Join" not in plan


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([t for t, _ in FOUND] + KEPT + ["\n", " ", "x", "é", "-", "token"]), max_size=6).map(" ".join), min_size=1, max_size=20))
def test_the_same_as_python(spark, texts):
    assert both(spark, texts) == [chain(t) for t in texts]


def test_order_is_part_of_the_result(spark):
    assert both(spark, ["ghp_" + "a" * 25 + " internationalization"])[0][0] == "<REDACTED:<REDACTED:TOKEN>"


def test_null_and_dates(spark):
    df = spark.createDataFrame([(None,), ("on 2024-01-05 and 3/4/21, not 2024-01",)], "t string")
    assert [r[0] for r in df.select(redact.day_dates(F.col("t"))).collect()] == [0, 2]
    assert df.select(redact.redact(F.col("t"))).first()[0] is None


def test_email_text(spark):
    df = spark.createDataFrame([("Dear Ms. Oleander Quist, born 30 Sep 1987, of 905 Juniper Hollow Road, Corvallis OR 97330",)], "t string")
    assert df.select(redact.redact_email_text(F.col("t"))).first()[0] == "Dear Ms. <REDACTED:PERSON>, born <REDACTED:DATE_OF_BIRTH>, of <REDACTED:ADDRESS>, Corvallis OR <REDACTED:ZIP_CODE>"


@pytest.mark.parametrize(("markup", "text"), [("<p>a</p>b", "a\nb\n"), ("123-<b>45</b>-6789", "123-45-6789\n"), ("<head><title>x</title></head>y<script>z()</script>", "y\n"), ("a<br>b<!-- c -->&amp;d", "a\nb&d\n"), ("", "\n"), ("<p>a<p><p><p>b", "a\n\nb\n")])
def test_flatten(spark, markup, text):
    assert html_to_text(markup) == text


def test_flatten_column(spark):
    df = spark.createDataFrame([("<p>a</p>",), (None,)], "h string")
    assert [r[0] for r in df.select(html_text("h")).collect()] == ["a\n", None]


@pytest.mark.parametrize(("glob", "yes", "no"), [("*patient*", ["a.b.patient_x"], ["a.b"]), ("raw.*", ["raw.a.b"], ["xraw.a"]), ("a?c", ["abc"], ["ac"]), ("[ab]x", ["ax", "bx"], ["cx"]), ("[!ab]x", ["cx"], ["ax"]), ("a.b", ["a.b"], ["axb"]), ("x_y%", ["x_y%"], ["xay"])])
def test_globs(spark, glob, yes, no):
    g = Globs([glob])
    assert all(x in g for x in yes) and not any(x in g for x in no)
    df = spark.createDataFrame([(x,) for x in yes + no], "x string")
    assert [r[0] for r in df.select(g.matches(F.col("x"))).collect()] == [True] * len(yes) + [False] * len(no)
    assert re.compile(to_regex(glob))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab \n\r\x0b\x0c\x1c\x85  ", max_size=12))
def test_lines_as_python_splits(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, text string")
    got = [r["line"] for r in lines(df, "text", "k").orderBy("line_no").collect()]
    assert got == text.splitlines()


def sql_texts():
    """Texts that the SQL's dialect takes otherwise than Python: neighbours of hits, ASCII words, folds, line ends."""
    phone, ssn, gap = f"{_digits(3)}-555-{_digits(4)}", _digits(9), "x" * 17
    return [
        f"{phone} {phone}", f"{phone}\n{phone}\n", f"({phone[:3]}) {phone[4:]} ({phone[:3]}) {phone[4:]}", f"{ssn} {ssn} ssn", f"{ssn} ssn {ssn} ssn", f"{ssn} {gap} ssn", f"{ssn} {gap}y ssn",
        f"\u00e9{phone[:3]}-12-{_digits(4)}", "n. \u0661\u0662\u0663-\u0664\u0665-\u0666\u0667\u0668\u0669", "\u00e0 \u00e9lodie@caf\u00e9.fr or elodie@cafe.fr", f"account\x0bno {ssn}", f"acct \u00e9 {ssn}", f"to\u212aen: {_letters(20)}", f"ap\u0131key: {_letters(20)}", f"secret: {_letters(8)}\u017f{_letters(8)}", "", None,
    ]


def same_as_sql(spark, tmp_path, name, table, columns, rows):
    """The query on a table of these rows is its SQL."""
    df = spark.createDataFrame(rows, columns)
    df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    key, text = df.columns[0], df.columns[-1]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = dict(con.execute(f"SELECT {key}, {text} FROM ({queries.oracle_sql()[name]})").fetchall())
    got = {r[key]: r[text] for r in queries.queries()[name](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == len(rows)


def test_redact_documents_is_its_sql_on_odd_texts(spark, tmp_path):
    same_as_sql(spark, tmp_path, "redact_documents", "documents", "doc_id long, text string", list(enumerate(sql_texts())))


def test_redact_pages_is_its_sql_on_odd_texts(spark, tmp_path):
    same_as_sql(spark, tmp_path, "redact_pages", "pages", "page_id long, html string", [(i, t and f"<p>{t}</p>\n{t}") for i, t in enumerate(sql_texts())])


def test_redact_planted_is_its_sql_on_odd_texts_and_ids(spark, tmp_path):
    same_as_sql(spark, tmp_path, "redact_planted", "documents", "doc_id long, text string", [(i, t) for i, t in enumerate(sql_texts(), -9)] + [(10**12 + i, f"{_digits(3)}-555-{_digits(4)}") for i in range(6)] + [(None, "x")])
