from __future__ import annotations

import base64
import random

from pyspark.sql import functions as F

from patchwell.llm import language as lg
from patchwell.llm.common import table
from patchwell.llm.queries import QUERIES
from tests.llm.conftest import SF

SF1 = "/root/testdata/sf0.01"


def test_held_out_accuracy_of_the_text_alone(spark):
    docs = table(spark, SF1, "documents").where("length(text) > 100")
    train = docs.where("doc_id % 2 = 0").selectExpr("doc_id as key", "text", "lang as language")
    rows = lg.document_rows(docs.where("doc_id % 2 = 1"))
    found = lg.identify(rows, "doc_id", train).collect()
    assert sum(r.text_language == r.declared for r in found) > 0.98 * len(found)


def test_all_documents_are_recognised(spark):
    found = lg.documents_languages(table(spark, SF1, "documents")).collect()
    assert all(r.recognised for r in found) and len(found) == 1000
    assert sum(r.language == r.declared for r in found) > 990


def test_pages_by_markup_address_and_host(spark):
    pages = table(spark, SF, "pages")
    plain = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style).*?</\\1>", " "), "<[^>]*>", " ")
    # half the texts are gone: what pages declare and their hosts decide
    text = pages.select("page_id", F.when(F.col("page_id") % 2 == 0, plain).otherwise("").alias("text"))
    found = lg.identify(lg.page_rows(pages, text), "page_id").collect()
    assert sum(r.language == r.declared for r in found) > 0.9 * len(found)
    assert all(r.recognised == (r.page_id % 2 == 0) for r in found)


def test_parts_of_addresses_and_markup(frame):
    rows = frame(
        [("https://u@Blog.Ex.co.UK:80/x", '<!doctype html><HTML dir=ltr lang="pt-BR">'), ("no address", "<html>"), (None, None)],
        "url string, html string",
    )
    out = rows.select(lg.host_of("url"), lg.suffix_of("url"), lg.markup_language("html")).collect()
    assert [tuple(r) for r in out] == [("blog.ex.co.uk", "uk", "pt"), (None, None, None), (None, None, None)]


def test_odd_rows(docs, odd_rows):
    given = docs(odd_rows)
    found = lg.documents_languages(given).collect()
    assert len(found) == len(odd_rows)
    assert {r.recognised for r in found if r.doc_id in (1, 2)} == {False}
    kept = lg.keep_recognised(given)
    assert kept.columns == given.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {4, 5, 6, 7} <= set(ids) and ids.count(6) == 2 and ids.count(None) == 1 and not {1, 2} & set(ids)
    assert lg.documents_languages(docs([])).count() == 0 and lg.keep_recognised(docs([])).count() == 0


def test_texts_of_no_known_language_are_not_recognised(spark, docs):
    train = table(spark, SF1, "documents").selectExpr("doc_id as key", "text", "lang as language")
    texts = {
        1: "0123 4567 8901 " * 30,
        2: "*** --- ### === " * 30,
        3: base64.b64encode(random.Random(1).randbytes(600)).decode(),
        4: "Työväenopiston kevätlukukauden ilmoittautuminen käynnistyy yhdeksältä. " * 3,
        5: "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 3,
        6: train.where("language = 'fr'").first().text,
    }
    found = lg.identify(lg.document_rows(docs(list(texts.items()))), "doc_id", train).collect()
    assert {r.doc_id for r in found if r.recognised} == {6}


def test_more_languages_than_sixty_four(frame):
    rnd = random.Random(4)
    words = [["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for _ in range(70)]
    rows = [(70 * i + k, " ".join(rnd.choice(words[k]) for _ in range(60)), f"l{k}", "s") for k in range(70) for i in range(2)]
    given = frame(rows, "doc_id long, text string, lang string, source string")
    found = lg.identify(lg.document_rows(given).withColumn("host", F.lit(None).cast("string")), "doc_id").collect()
    assert len({r.text_language for r in found}) == 70 and all(r.text_language == r.declared and r.recognised for r in found)


def test_all_pages_are_classified_by_a_query(spark):
    found = QUERIES["op4_page_language_id"](spark, SF).collect()
    pages = table(spark, SF, "pages").count()
    assert len(found) == pages and sum(r.language == r.declared for r in found) > 0.9 * pages


def test_markup_language_after_a_long_prolog(frame):
    prolog = "<!DOCTYPE html><!-- <html lang=xx> " + "x" * 9000 + " -->"
    rows = frame([(prolog + '<html class=a lang="de">',), (prolog + '<html><body><html lang="en">',), ('<html data-lang="fr">',)], "html string")
    assert [r[0] for r in rows.select(lg.markup_language("html")).collect()] == ["de", None, None]
