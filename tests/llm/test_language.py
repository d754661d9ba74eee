import random

import pytest

from lodestack.llm import language as L

NAMES = ["Brimoford", "Sundershaw", "Kellavale", "Thornwick", "Galdholt", "Wendmere"]
PARTS = {
    "en": (["The hospital", "A nurse", "The review board", "Our office", "The county report"], ["checked", "published", "delayed", "withheld", "compared"], ["the number of patients", "two rows of the table", "the old name of the site", "the survey of last year"], ["before the spring release", "because the file was incomplete", "in the smallest counties only", "without changing the total"]),
    "es": (["El hospital", "Una enfermera", "La junta de revisión", "Nuestra oficina", "El informe del condado"], ["revisó", "publicó", "retrasó", "ocultó", "comparó"], ["el número de pacientes", "dos filas de la tabla", "el nombre antiguo del centro", "la encuesta del año pasado"], ["antes de la entrega de primavera", "porque faltaban varias filas", "sólo en los condados pequeños", "sin cambiar el total"]),
    "fr": (["L'hôpital", "Une infirmière", "La commission de relecture", "Notre bureau", "Le rapport du comté"], ["a vérifié", "a publié", "a retardé", "a masqué", "a comparé"], ["le nombre de patients", "deux lignes du tableau", "l'ancien nom du site", "l'enquête de l'année dernière"], ["avant la livraison du printemps", "parce que le fichier était incomplet", "seulement dans les petits comtés", "sans changer le total"]),
    "de": (["Das Krankenhaus", "Eine Pflegerin", "Die Prüfstelle", "Unser Büro", "Der Bericht des Landkreises"], ["prüfte", "veröffentlichte", "verzögerte", "verschwieg", "verglich"], ["die Zahl der Patienten", "zwei Zeilen der Tabelle", "den alten Namen des Hauses", "die Umfrage des letzten Jahres"], ["vor der Ausgabe im Frühling", "weil die Datei unvollständig war", "nur in den kleinsten Landkreisen", "ohne die Summe zu ändern"]),
    "pt": (["O hospital", "Uma enfermeira", "A comissão de revisão", "O nosso escritório", "O relatório do condado"], ["verificou", "publicou", "atrasou", "ocultou", "comparou"], ["o número de doentes", "duas linhas da tabela", "o nome antigo da unidade", "a pesquisa do ano passado"], ["antes da entrega da primavera", "porque faltavam muitas linhas", "apenas nos condados menores", "sem mudar o total"]),
    "it": (["L'ospedale", "Un'infermiera", "La commissione di verifica", "Il nostro ufficio", "Il rapporto della contea"], ["ha controllato", "ha pubblicato", "ha ritardato", "ha nascosto", "ha confrontato"], ["il numero dei pazienti", "due righe della tabella", "il vecchio nome della sede", "il questionario dell'anno scorso"], ["prima della consegna di primavera", "perché mancavano molte righe", "soltanto nelle contee più piccole", "senza cambiare il totale"]),
    "zh": (["医院", "夜班护士", "审查委员会", "我们的办公室", "县里的报告"], ["检查了", "公布了", "推迟了", "隐去了", "比较了"], ["患者的人数", "表格中的两行", "医院的旧名称", "去年的问卷"], ["在春季发布之前", "因为文件不完整", "只限于最小的县", "但总数没有变化"]),
    "ru": (["Больница", "Медсестра", "Комиссия по проверке", "Наше бюро", "Отчёт округа"], ["проверила", "опубликовала", "задержала", "скрыла", "сравнила"], ["число пациентов", "две строки таблицы", "старое название отделения", "опрос прошлого года"], ["до весеннего выпуска", "из-за неполного файла", "только в самых малых округах", "без изменения итога"]),
}
IN = {"en": "in {} County", "es": "en {} County", "fr": "à {} County", "de": "in {} County", "pt": "em {} County", "it": "a {} County", "zh": "", "ru": "в {} County"}


def sentence(rng, lang):
    words = [rng.choice(p) for p in PARTS[lang]]
    if rng.random() < 0.3 and IN[lang]:
        words.insert(3, IN[lang].format(rng.choice(NAMES)))
    return ("".join(words) + "。") if lang == "zh" else " ".join(words) + "."


def text(rng, lang, n):
    return ("" if lang == "zh" else " ").join(sentence(rng, lang) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(480):
        lang = rng.choice(L.LANGUAGES)
        label = lang if rng.random() < 0.85 else rng.choice([None, "", "unknown", rng.choice(L.LANGUAGES)])
        rows.append((i, text(rng, lang, rng.randint(2, 6)), label, {lang}))
    return rows


@pytest.fixture(scope="module")
def model(spark, corpus):
    df = spark.createDataFrame([(i, t, l) for i, t, l, _ in corpus], "doc_id int, text string, lang string")
    return L.fit(df, "doc_id", "text", "lang")


def languages(model, texts):
    return [{L.LANGUAGES[i] for i in L.counted(f)} for f in L.judged(texts, model)]


def test_held_out_accuracy(model):
    rng = random.Random(12)
    cases = [(lang, text(rng, lang, rng.randint(1, 4))) for lang in L.LANGUAGES for _ in range(40)]
    got = languages(model, [t for _, t in cases])
    assert sum(g == {lang} for g, (lang, _) in zip(got, cases)) >= 0.98 * len(cases)


def test_capitals_lost_accents_and_no_stops(model):
    rng = random.Random(13)
    cases = [(lang, text(rng, lang, 3)) for lang in L.LANGUAGES for _ in range(12)]
    for change in (str.upper, L.without_accents, lambda t: t.lower().replace(".", "").replace("。", "")):
        got = languages(model, [change(t) for _, t in cases])
        assert sum(g == {lang} for g, (lang, _) in zip(got, cases)) >= 0.95 * len(cases)


def test_mixed_texts(model):
    rng = random.Random(14)
    cases = []
    for _ in range(60):
        a, b = rng.sample(L.LANGUAGES, 2)
        cases.append(({a, b}, text(rng, a, 3) + rng.choice(["\n", "\n\n", " "]) + text(rng, b, rng.randint(1, 2))))
    got = languages(model, [t for _, t in cases])
    assert sum(g == w for g, (w, _) in zip(got, cases)) >= 0.95 * len(cases)


def test_what_does_not_count(model):
    rng = random.Random(15)
    spanish = text(rng, "es", 3)
    extra = "\n\nfacility_id | condition | ratio\n1 | HF | 1.0\n\n```sql\nselect the number of rows from the table where the value is incomplete\n```\nName: Saint Thornwick Hospital\n# The old name of the site\n"
    assert languages(model, [spanish + extra, spanish + " Thornwick Memorial Hospital", "1.02, 3.4\n5", "", " \n ", "|||"]) == [{"es"}, {"es"}, set(), set(), set(), set()]


def test_tab_runs_in_prose(model):
    rng = random.Random(18)
    for run in (" \t\t\t  ", "\t\t\t", "\t \t"):
        for lang in L.LANGUAGES:
            a, b = text(rng, lang, 1), text(rng, lang, 1)
            joined = (a if lang == "zh" else a.rstrip(".")) + run + b
            assert languages(model, [joined, run + a, joined + run + b]) == [{lang}] * 3, (run, lang)
            assert L._merged(L.judged([joined], model)[0])[0]["lang"] == lang
    rows = "facility_id\tcondition\tdischarges\tratio\n350031\tAMI\t72\t0.9133\nSaint Thornwick Hospital\tHF\t\tthe file was incomplete before the spring release\nSaint Thornwick Hospital\tAcute Care Hospitals\tof the county\n"
    assert languages(model, [rows, text(rng, "es", 2) + "\n" + rows]) == [set(), {"es"}]


def test_languages_that_meet_without_a_stop(model):
    rng = random.Random(19)
    bare = lambda lang: sentence(rng, lang).rstrip(".。").lower()
    cases, alone = [], []
    for _ in range(100):
        a, b = rng.sample([x for x in L.LANGUAGES if x != "zh"], 2)
        short = " ".join(bare(b).split()[:6])
        cases += [({a, b}, bare(a) + join + bare(b) + "!") for join in (" ", " / ")]
        cases.append(({a, b}, " ".join([bare(a), bare(a), short, bare(a), bare(a)])))
        alone += [({a}, " ".join(bare(a) for _ in range(4)) + end) for end in ("", "!")]
    for some in (cases, alone):
        got = languages(model, [t for _, t in some])
        assert sum(g == w for g, (w, _) in zip(got, some)) >= 0.95 * len(some)


def test_short_text_has_a_language(model):
    assert languages(model, ["The hospital."]) == [{"en"}]


def test_segments_cover_languages(model):
    rng = random.Random(16)
    a, b = text(rng, "de", 2), text(rng, "ru", 2)
    found = L.judged([a + "\n" + b], model)[0]
    assert {L.LANGUAGES[s.lang] for s in found if s.end <= len(a) + 1} == {"de"} and {L.LANGUAGES[s.lang] for s in found if s.start > len(a)} == {"ru"}


def test_frames(spark, model):
    rng = random.Random(17)
    en, es = text(rng, "en", 2), text(rng, "es", 2)
    rows = [(1, en, "en-US"), (2, en, "es"), (3, en, None), (4, en + "\n" + es, "en"), (5, None, None), (6, "", "en"), (7, "12 34", None), (8, es, "Spanish"), (9, es, "??"), (9, es, "??"), (10, es * 300, "ES-mx"), (None, en, "fr")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, lang string, segments string")
    got = sorted((r["doc_id"] or 0, r["lang"]) for r in L.wrong_labels(df, "doc_id", "text", "lang", model).collect())
    assert got == [(0, "en"), (2, "en"), (3, "en"), (4, "en"), (4, "es"), (9, "es"), (9, "es")]
    out = {r["doc_id"]: r for r in L.identify(df.where("doc_id is not null"), "doc_id", "text", model).collect()}
    assert out[4]["languages"] and out[5]["lang"] is None and out[5]["languages"] == [] and out[1]["confidence"] > 0.5
    assert L.identify(df.limit(0), "doc_id", "text", model).count() == 0


@pytest.mark.parametrize("label,want", [("EN", "en"), ("pt-BR", "pt"), ("Deutsch", "de"), (" zh_CN ", "zh"), ("unknown", None), ("??", None), ("", None), (None, None), ("nl", "nl")])
def test_labels(spark, label, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(label,)], "l string").select(L.canonical_label(F.col("l")).alias("x")).first()["x"] == want


def test_fit_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id int, text string, lang string")
    model = L.fit(df, "doc_id", "text", "lang")
    assert L.wrong_labels(df, "doc_id", "text", "lang", model).count() == 0
    assert L.wrong_labels(df.limit(0), "doc_id", "text", "lang", L.fit(df.limit(0), "doc_id", "text", "lang")).count() == 0


def test_other_languages_are_rejected(model):
    """Nothing is forced into the eight languages, however short the text is."""
    texts = [
        "Pielęgniarka sprawdziła wszystkie wiersze tabeli przed końcem miesiąca.",
        "Hemşire ayın sonundan önce tablonun bütün satırlarını gözden geçirdi.",
        "Gwiriodd y nyrs bob rhes o'r tabl cyn diwedd y mis.",
        "Sairaanhoitaja tarkasti kaikki taulukon rivit ennen kuukauden loppua.",
        "Dziękujemy bardzo.",
    ]
    assert languages(model, texts) == [set()] * len(texts)


def test_scores_are_cosines(model):
    import numpy as np

    assert np.allclose(np.linalg.norm(model.centroids, axis=0), 1, atol=1e-4)
    rows = ["the hospital checked the number of patients", "die prüfstelle verglich zwei zeilen"]
    row, _, weight = model.vectors(rows)
    assert np.allclose(np.bincount(row, weight**2), 1, atol=1e-4) and np.abs(model.scores(rows)).max() <= 1


def test_occurrences_are_counted_once_a_row():
    import numpy as np

    rows = ["aa aa aa", "aa bb", "", "北京 北京"] * 40
    want = np.zeros(L.FEATURES, int)
    for r in rows:
        want[np.unique(L.grams([r])[1])] += 1
    assert (L.rows_with(rows) == want).all()


def test_training_stretches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "TRAINING_TEXTS", 3)
    rng = random.Random(21)
    rows = [(i % 5, text(rng, "en", 30), "english") for i in range(10)] + [(9, "x", "pl"), (9, None, "en"), (None, text(rng, "de", 2), "de")] + [(77, "The same text stands here again.", "en")] * 50
    made = L.training_stretches(spark.createDataFrame(rows, "i int, t string, l string"), "i", "t", "l")
    assert made.groupby("__l").size().to_dict() == {"de": 1, "en": 3} and max(len(p) for p in made["__p"]) <= L.TRAINING_STRETCHES
