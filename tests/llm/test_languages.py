import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import languages as la

SENTENCES = {
    "en": ["The teacher wrote two drafts and only one of them is whole.", "We keep the value and round only at the very end.", "After that the row reads as the example says."],
    "de": ["Der Lehrer schrieb zwei Entwürfe und nur einer davon ist vollständig.", "Wir behalten den Wert und runden erst ganz am Schluss.", "Danach lautet die Zeile so wie im Beispiel angegeben."],
    "fr": ["Le professeur a écrit deux brouillons et un seul est complet.", "Nous gardons la valeur et nous arrondissons à la toute fin.", "Après cela la ligne devient ce que dit l'exemple."],
    "zh": ["教师写了两份草稿，其中只有一份是完整的。", "我们保留这个数值，到最后才四舍五入。", "然后这一行变成例子所示的样子。"],
    "ru": ["Учитель написал два черновика, и только один из них полный.", "Мы сохраняем значение и округляем только в самом конце.", "После этого строка принимает вид, как сказано в примере."],
}


def corpus(rnd, n):
    return [(lang, "\n\n".join(" ".join(rnd.choices(SENTENCES[lang], k=3)) for _ in range(2))) for lang in SENTENCES for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    rows = corpus(rnd, 30)
    return la.Model([(rnd.choice(list(SENTENCES)) if rnd.random() < 0.1 else lang, t) for lang, t in rows])


@pytest.mark.parametrize(
    ("label", "want"),
    [("en", "en"), (" EN ", "en"), ("en-GB", "en"), ("English", "en"), ("fr_FR", "fr"), ("zho", "zh"), ("", None), (None, None), ("und", None), ("??", None), ("n/a", None), (" ", None), ("ja", "ja"), ("pol", "pl"), ("pt-BR", "pt"), ("weird label", "?"), ("x1", "?")],
)
def test_labels(label, want):
    assert la.declared(label) == want


def test_paragraphs():
    assert la.paragraphs("a\nb\n \t\n\r\nc\r\n \r\nd\n\n") == ["a\nb", "c", "d"] and la.paragraphs(" \n\n") == []


def test_damage(model):
    t = SENTENCES["fr"][0] + " " + SENTENCES["fr"][1]
    broken = t.encode().decode("latin-1")
    for form in (t.upper(), la.fold(t), broken, "​" + t):
        assert model.judge(form, None, None)[0] == "fr"


def test_mixed_document(model):
    text = "## Heading 3\n\n" + SENTENCES["en"][0] + "\n\n0101 -> 1010\n\n" + SENTENCES["de"][1] + "\n\n" + SENTENCES["en"][2] + " (\"сумма цифр\")"
    main, rows = model.judge(text, "de", None)
    assert main == "en" and [(n, x) for n, x, _ in rows] == [(0, "en"), (4, "de")] and all(0 < c <= 1 for _, _, c in rows)


@pytest.mark.parametrize("text", [None, "", " \n\n", "x2 = (x3 ^ 0b1100) << 5", "| 73 | 0.06 |", "## Title 3", "1 + 2 = 3"])
def test_no_prose(model, text):
    assert model.judge(text, "en", None) == (None, [])


def test_held_out(model):
    rows = corpus(random.Random(9), 20)
    assert sum(model.judge(t, None, None)[0] == lang for lang, t in rows) == len(rows)


def test_operator(spark):
    rnd = random.Random(3)
    rows = [(i, t, lang, "Src" if i % 2 else None, 0, 0.5, lang) for i, (lang, t) in enumerate(corpus(rnd, 25))]
    rows += [(900, rows[0][1], "fr", "src", 0, 0.5, ""), (900, rows[0][1], "fr", "src", 0, 0.5, ""), (901, rows[0][1], None, None, 0, 0.5, ""), (902, None, "en", None, 0, 0.5, ""), (903, "0 1", None, None, 0, 0.5, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, para_no int, confidence double, prior string")
    got = sorted(map(tuple, la.wrong_labels(d).collect()))
    want = rows[0][2]
    assert got == [(900, 0, want), (900, 0, want), (901, 0, want)]
    assert la.languages(d).where("para_no = 0").count() == 128
    assert la.wrong_labels(d.limit(0)).count() == 0


STRANGERS = {
    "pl": "Zaczynamy od najkrótszego przykładu i zapisujemy, co się zmienia. Potem sprawdzamy wszystkie pozostałe wiersze.",
    "sv": "Vi börjar med det kortaste exemplet och skriver ned vad som ändras. Sedan räknar vi om alla rader igen.",
    "uk": "Ми починаємо з найкоротшого прикладу і записуємо кожну зміну. Потім перевіряємо всі інші рядки ще раз.",
    "ja": "私たちは最も短い例から始めて、変化をすべて書き留めます。それから残りの行を確認します。",
    "tr": "En kısa örnekle başlıyoruz ve neyin değiştiğini yazıyoruz. Sonra bütün satırları yeniden kontrol ediyoruz.",
}


@pytest.mark.parametrize("lang", sorted(STRANGERS))
def test_a_stranger_is_in_no_known_language(model, lang):
    assert model.judge(STRANGERS[lang], lang)[0] == la.OTHER and model.judge(STRANGERS[lang])[0] == la.OTHER
    # a paragraph of it in a known text
    main, rows = model.judge(SENTENCES["en"][0] + "\n\n" + STRANGERS[lang] + "\n\n" + SENTENCES["en"][1])
    assert main == "en" and [(n, x) for n, x, _ in rows] == [(0, "en"), (2, la.OTHER)]


def test_a_language_of_the_labels_is_learned():
    rnd = random.Random(2)
    rows = corpus(rnd, 20) + [("sv", STRANGERS["sv"])] * 8
    m = la.Model(rows)
    assert "sv" in m.langs and m.judge(STRANGERS["sv"])[0] == "sv"
    # a code that stands on texts of other languages is none
    assert "bg" not in la.Model(rows + [("bg", t) for _, t in corpus(rnd, 3)]).langs


def test_a_wrong_code_with_a_full_sample_is_no_language(spark, small):
    d = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang", "source").where("lang is not null")
    # every fourth Russian text has another code, and copies fill the sample of either
    russian = (la.declared_column(F.col("lang")) == "ru") & (F.col("doc_id") % 4 == 0)
    d = d.withColumn("lang", F.when(russian, "bg").otherwise(F.col("lang")))
    many = d.crossJoin(spark.range(8).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") + 10_000 * F.col("copy")).drop("copy")
    m = la.fit(many, sample=30)
    assert m.langs == ("de", "en", "es", "fr", "it", "nl", "pt", "ru", "zh")
    named = d.where("lang = 'bg'").select("doc_id").join(la.wrong_labels(d, m), "doc_id").where("para_no = 0").collect()
    assert len(named) >= 10 and sum(r.true_lang == "ru" for r in named) >= len(named) - 1


def test_a_rare_language_beside_its_neighbours_is_learned():
    rnd = random.Random(8)
    danish = "Vi begynder med det korteste eksempel og skriver ned, hvad der ændrer sig. Så regner vi alle rækkerne efter igen."
    rows = corpus(rnd, 20) + [("sv", STRANGERS["sv"])] * 8 + [("da", danish)] * 8
    m = la.Model(rows, dict.fromkeys(SENTENCES, 10_000) | {"sv": 900, "da": 8})
    assert {"sv", "da"} <= set(m.langs) and m.judge(danish)[0] == "da" and m.judge(STRANGERS["sv"])[0] == "sv"


def test_evidence_decides_close_cases(model):
    even = SENTENCES["en"][0] + "\n\n" + SENTENCES["de"][0]
    assert model.judge(even, "de")[0] == "de" and model.judge(even, "en")[0] == "en"
    assert model.judge(even, None, None, "de-AT")[0] == "de" and model.judge(even, None, None, None, "uk")[0] == "en" and model.judge(even, None, {"de": 0.9, "en": 0.1})[0] == "de"
    assert all(0.4 < model.judge(even, x)[1][0][2] < 1 for x in ("de", "en"))
    # but most paragraphs outweigh label and host
    most = even + "\n\n" + SENTENCES["en"][1]
    assert model.judge(most, "de", {"de": 0.99, "en": 0.01})[0] == "en"


def test_priors_are_smoothed_by_group(spark):
    rows = [("a.x.org", "de")] * 40 + [("b.x.org", "de")] * 40 + [("c.x.org", "en")] + [("d.y.net", "en")] * 40 + [("e.y.net", None), (None, "en"), (None, "??")]
    d = spark.createDataFrame(rows, "source string, lang string")
    p = {r.source: r.prior for r in la.host_priors(d).collect()}
    assert all(sum(x.values()) == pytest.approx(1.0) for x in p.values())
    # one label of its own hardly moves a host of a German group
    assert p["a.x.org"]["de"] > p["c.x.org"]["de"] > 0.8 > 0.3 > p["d.y.net"]["de"] and set(p) == {"a.x.org", "b.x.org", "c.x.org", "d.y.net", ""}
    assert la.host_priors(d.limit(0)).count() == 0


def test_markup_and_address_columns(spark, model):
    even = SENTENCES["en"][0] + "\n\n" + SENTENCES["de"][0]
    rows = [(1, even, None, None, "de", None), (2, even, None, None, None, "https://www.news.co.uk/a.html"), (3, even, None, None, "de-CH", "http://x.de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, markup_lang string, url string")
    assert {r.doc_id: r.true_lang for r in la.languages(d, model).where("para_no = 0").collect()} == {1: "de", 2: "en", 3: "de"}


def test_held_out_on_the_test_data(spark, small):
    d = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    odd = d.where("doc_id % 2 = 1")
    model = la.fit(odd)
    rest = [r for r in d.where("doc_id % 2 = 0").collect() if la.declared(r.lang) in model.langs]
    judged = [(la.declared(r.lang), *model.judge(r.text, r.lang)) for r in rest]
    judged = [(a, b, rows[0][2]) for a, b, rows in judged if b]
    right = sum(a == b for a, b, _ in judged) / len(judged)
    assert right > 0.85  # some labels are wrong
    # confidence is that of the label's language as often as it says, but for the labels' own faults
    assert abs(sum(c for _, _, c in judged) / len(judged) - right) < 0.1
