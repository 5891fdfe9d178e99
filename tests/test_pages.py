"""Queries over all page captures, the documents' included, against known answers and brute force."""

import re

import pyspark.sql.functions as F
import pytest

from ledgerline.functions import patterns as P
from ledgerline.operators import content as C
from ledgerline.plans import content
from ledgerline.sources.shared import table

SF = "/root/testdata/sf0.001"
HTML = {
    1: "<p>the customer contract is confidential</p><a href='/x'>l</a><script src='/s.js'></script>",
    2: "plain capture, mail a@b.test",
    3: "<div hidden>internal use only</div><input type=password><script>fetch('/api/login')</script>",
    4: "",
    5: None,
}


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pages"))
    rows = [(i, t, "page-capture") for i, t in HTML.items()] + [(6, "confidential customer", "memo")]
    spark.createDataFrame(rows, "doc_id bigint, text string, doc_kind string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "n", "b", 7)], "p_partkey bigint, p_name string, p_brand string, p_size int").write.parquet(f"{at}/part.parquet")
    return at


def test_real_pages_come_out(spark, pages):
    codes = {r.id: (r.codes, r.marker_region) for r in content.QUERIES["ref_C9_C20_page_signals_all"](spark, pages).collect()}
    made = codes.pop(-2)
    assert made == ("HIDDEN_DOM_PRESENT LOGIN_FORM_INDICATOR RUNTIME_ENDPOINT_CANDIDATE", None)
    assert codes == {
        1: ("CONFIDENTIAL_MARKER_CANDIDATE", "visible_body"),
        2: ("EMAIL_VALUE_CANDIDATE", None),
        3: ("CONFIDENTIAL_MARKER_CANDIDATE HIDDEN_DOM_PRESENT LOGIN_FORM_INDICATOR RUNTIME_ENDPOINT_CANDIDATE", "hidden_body"),
        4: ("", None),
    }
    flags = {r.id: (r.business_words, r.server_call, r.login_endpoint, r.password_input) for r in content.QUERIES["ref_C32_gate_flags_all"](spark, pages).collect()}
    assert flags == {-2: ("commission", True, False, True), 1: ("customer_contract", False, False, False), 2: ("", False, False, False), 3: ("", True, True, True), 4: ("", False, False, False)}
    found = {(r.id, r.relation, r.url) for r in content.QUERIES["ref_U6_references_all"](spark, pages).collect()}
    assert found == {(-2, "a", "/p/1"), (-2, "fetch_literal", "/api"), (1, "a", "/x"), (1, "script", "/s.js"), (3, "fetch_literal", "/api/login")}


def test_document_names_in_scripts(spark):
    body = """<script>const a = "/files/Plan.PDF?x=1"; fetch('/api'); let b = 'https:\\/\\/d.test\\u002fq.xlsx', c = "not.a document.txt";</script><a href="/x.pdf">x</a>"""
    rows = C.references(spark.createDataFrame([(1, body)], "id bigint, body string")).collect()
    assert {(r.relation, r.url) for r in rows} == {("a", "/x.pdf"), ("fetch_literal", "/api"), ("document_literal", "/files/Plan.PDF?x=1"), ("document_literal", "https://d.test/q.xlsx")}


def test_real_pages_against_brute_force(spark):
    """The captures hold only simple tags, so their text without the tags is the visible text."""
    texts = {r.doc_id: re.sub(r"<[^>]*>", " ", r.text) for r in table(spark, SF, "documents").where("doc_kind = 'page-capture' and text is not null").collect()}
    words = {i: ",".join(k for k, p in C.GATE_WORDS.items() if re.search(p, t, re.I)) for i, t in texts.items()}
    flags = content.QUERIES["ref_C32_gate_flags_all"](spark, SF).where(F.col("id") >= 1)
    assert {r.id: r.business_words for r in flags.collect()} == words
    codes = content.QUERIES["ref_C9_C20_page_signals_all"](spark, SF).where(F.col("id") >= 1)
    rules = (("EMAIL_VALUE_CANDIDATE", P.EMAIL, 0), ("CONFIDENTIAL_MARKER_CANDIDATE", P.CONFIDENTIAL, re.I))
    assert {r.id: r.codes for r in codes.collect()} == {i: " ".join(c for c, p, f in rules if re.search(p, t, f)) for i, t in texts.items()}
    assert texts and any(words.values())


def test_values_and_verdicts_of_pages(spark, tmp_path):
    page = "<p>mail a@b.test, [tel</p> 010-1234-5678<div hidden>a@b.test 12가3456</div><input value='109-86-31667'><img src=x><script>let k = 'sb_secret_abcdefghijkl0'; pw = 'abcd1234'</script><script type='application/json'>{broken</script>"
    docs = [(1, page, "page-capture"), (2, "<b>900101-1234567</b>", "page-capture"), (3, "<p>[nothing</p>", "page-capture"), (4, "SYNTHETIC_CANARY_1 a@b.test", "page-capture"), (5, None, "page-capture"), (6, "a@b.test", "memo")]
    spark.createDataFrame(docs, "doc_id bigint, text string, doc_kind string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name: sorted(tuple(r) for r in content.QUERIES[name](spark, str(tmp_path)).where("id > 0").collect())
    assert got("ref_F1_email_signals_all") == [(1, 2, 1, "a*@b.test"), (4, 1, 1, "a*@b.test"), (6, 1, 1, "a*@b.test")]
    assert got("ref_F2_F3_number_signals_all") == [(1, "KR_PHONE_VALUE_CANDIDATE", 1), (2, "KR_RESIDENT_VALUE_CANDIDATE", 1)]
    assert got("ref_F4_plates_all") == [(1, 1)]
    assert got("ref_F5_business_numbers_all") == [(1, 1, 1)]
    assert got("ref_F7_secret_offsets_all") == [(1, "script", "SERVER_SECRET_CANDIDATE", 9)]
    codes = "CLIENT_PASSWORD_CANDIDATE EMAIL_VALUE_CANDIDATE HIDDEN_DOM_PRESENT JSON_PARSE_INCOMPLETE KR_BUSINESS_NUMBER_CANDIDATE KR_PHONE_VALUE_CANDIDATE KR_VEHICLE_PLATE_CANDIDATE SERVER_SECRET_CANDIDATE"
    assert got("ref_C2_C25_verdicts_all") == [
        (1, codes, "SENSITIVE_CANDIDATE", "image_or_base64_review"),
        (2, "KR_RESIDENT_VALUE_CANDIDATE", "SENSITIVE_CANDIDATE", ""),
        (3, "", "NOT_INSPECTED", ""),
        (4, "EMAIL_VALUE_CANDIDATE SYNTHETIC_CANARY_PRESENT", "SYNTHETIC_CONTENT_CONFIRMED", ""),
        (6, "EMAIL_VALUE_CANDIDATE", "SENSITIVE_CANDIDATE", ""),
    ]


def test_references_up_to_the_limit(spark):
    many = lambda n: "<a href='/same'>x</a>" * 70 + "".join(f"<a href='/{i}'>x</a>" for i in range(n)) + "<script src='/end.js'></script>"
    rows = C.references(spark.createDataFrame([(1, many(100)), (2, many(300)), (3, many(254))], "id bigint, body string")).collect()
    found = {i: {(r.relation, r.url) for r in rows if r.id == i} for i in (1, 2, 3)}
    links = lambda n: {("a", "/same")} | {("a", f"/{i}") for i in range(n)}
    assert found == {1: links(100) | {("script", "/end.js")}, 2: links(255) | {("reference_limit", None)}, 3: links(254) | {("script", "/end.js")}}
    assert len(rows) == 102 + 257 + 256
