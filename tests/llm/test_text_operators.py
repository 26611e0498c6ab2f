"""Text operators: held-out accuracy, round trips and edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagestrata.functions.html_scan import scan_blocks
from pagestrata.llm import main_text, mojibake, queries, residue, sentences, site_lines


def test_tree_accuracy_on_held_out_pages():
    tree = main_text.main_tree()
    pages = main_text.labelled_pages(seed=991, pages=150)
    x = np.concatenate([np.array(main_text.block_features(scan_blocks(p))) for p, _ in pages])
    y = np.concatenate([labels for _, labels in pages])
    assert ((tree.predict(x) >= 0.5) == y).mean() > 0.97


def test_tree_column_equals_predict(spark):
    tree = main_text.fit(np.array([[float(i), float(i % 3)] for i in range(60)]), np.array([int(i > 20 and i % 3 == 1) for i in range(60)]), min_leaf=2) if hasattr(main_text, "fit") else None
    rows = [(float(i), float(i % 3)) for i in range(60)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(tree.column([F.col("a"), F.col("b")])).collect()]
    assert np.allclose(got, tree.predict(np.array(rows)))


def test_main_text_edges(spark):
    page = "<body><ul>" + "".join(f"<li><a href='/{i}'>Menu {i}</a></li>" for i in range(8)) + "</ul><h1>A title of the page</h1><p>" + "Words of the article go on. " * 8 + "</p><p>© 2020 Somebody. All rights reserved.</p></body>"
    rows = [(1, page, "x"), (1, page, "x"), (2, None, "x"), (3, "", "x"), (4, "<p>" + "long text " * 50_000, "x"), (None, page, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, html string, block_no string")
    got = {(r["page_id"], r["block_no"]) for r in main_text.extract_main(df).collect()}
    assert {b for p, b in got if p == 1} == {9, 10} and (4, 1) in got and {b for p, b in got if p is None} == {9, 10} and not {p for p, _ in got} & {2, 3}
    assert main_text.extract_main(df.limit(0)).count() == 0


WORDS = "громада рада бюджет школа дорога звіт комітет депутат рішення проєкт лікарня вулиця площа реформа зустріч засідання програма освіта".split()


def titles(n=600, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(6)).capitalize() for _ in range(n)]


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1251", "latin-1"), ("koi8-u", "cp1251"), ("utf-8", "cp866")])
def test_mojibake_round_trip(spark, written, read):
    good = titles()
    table = mojibake._byte_map(read)
    back = {b: c for c, b in table.items()}
    bad = ["".join(back[b] for b in t.encode(written)) for t in good[:20]]
    legit = ["AÇÃO CIDADÃ – REUNIÃO Nº 4", "╔══ Архів ══╗", "Ñandelar: «mañana empieza»", "РС-24: СРСР", "Бюлетень № 5 — «ÄÖÜ»"] * 5
    rows = [("t", i, x, 0) for i, x in enumerate([*good, *bad, *legit, None, ""])]
    df = spark.createDataFrame(rows, "tab string, rec_id bigint, text string, restored int")
    freq = mojibake.count_frequencies(df.select("text"))
    found = {r["rec_id"] for r in mojibake.find_damaged(df.unionAll(df), freq).collect()}
    assert found == set(range(len(good), len(good) + 20))
    fixed = {r["rec_id"]: r["restored"] for r in mojibake.restore_damaged(df, freq).collect()}
    right = sum(fixed[len(good) + i] == good[i] for i in range(20))
    assert right >= 18


def test_lost_bytes_are_filled(spark):
    df = spark.createDataFrame([(t,) for t in titles()], "text string")
    freq = mojibake.count_frequencies(df)
    freq.top = mojibake.common_words(df)
    assert mojibake.fill_lost("гро�ада", freq) == "громада" and mojibake.fill_lost("��", freq) == "��"
    restorer = mojibake.Restorer(freq)
    assert restorer.damaged("лі�арня") and not restorer.damaged("лікарня") and not restorer.damaged(None) and restorer.restore("") == ("", None)


def test_misread_text_with_lost_bytes_is_decoded(spark):
    good = ["并且今年通过问题会议", "通过需要问题通过", *titles(200)]
    freq = mojibake.count_frequencies(spark.createDataFrame([(t,) for t in good], "text string"))
    restorer = mojibake.Restorer(freq)
    assert restorer.token("骞朵笖浠婂勾閫氳繃闂�棰樹細璁�") == ("utf-8>gbk", good[0])
    assert restorer.token("閫氳繃闇�瑕侀棶棰橀�氳繃") == ("utf-8>gbk", good[1])
    misread = "громада".encode().decode("cp1251")
    assert restorer.token(misread[:3] + "�" + misread[4:]) == ("utf-8>cp1251", "громада")


def test_lost_bytes_are_filled_from_all_words(spark):
    rows = [("t", 0, "гро�ада, засіда��я"), ("t", 1, "«рідк�слово»"), ("t", 2, "рідкіслово")] + [("t", 3 + i, x) for i, x in enumerate(titles())]
    df = spark.createDataFrame(rows, "tab string, rec_id bigint, text string")
    got = {r["rec_id"]: r["restored"] for r in mojibake.restore_damaged(df, mojibake.count_frequencies(df.select("text"))).collect()}
    assert got == {0: "громада, засідання", 1: "«рідкіслово»"}


def test_a_garbled_word_that_a_hot_site_repeats_is_found(spark):
    bad = "громада".encode("koi8-u").decode("cp1251")
    rows = [("t", i, x) for i, x in enumerate(titles())] + [("t", 1000 + i, f"{x} | {bad}") for i, x in enumerate(titles(300, 2))] + [("t", 2000 + i, bad) for i in range(300)]
    df = spark.createDataFrame(rows, "tab string, rec_id bigint, text string")
    got = {r["rec_id"] for r in mojibake.find_damaged(df, mojibake.count_frequencies(df.select("text"))).collect()}
    assert got == {i for _, i, _ in rows if i >= 1000}


def test_pages_are_restored_as_well_as_captures(spark, tmp_path):
    good = titles()
    back = {b: c for c, b in mojibake._byte_map("cp1252").items()}
    bad = ["".join(back[b] for b in t.encode()) for t in good[:3]]
    pages = [(i, f"<p>{t}</p>", (None,)) for i, t in enumerate(good)] + [(1000, f"<p>{bad[0]}</p>", (None,)), (1001, "<p>x</p>", (bad[1],))]
    spark.createDataFrame(pages, "page_id bigint, html string, wayback_metadata struct<title: string>").write.parquet(f"{tmp_path}/html_document.parquet")
    spark.createDataFrame([(7, bad[2]), (8, good[0])], "meta_id bigint, title string").write.parquet(f"{tmp_path}/snapshot_meta.parquet")
    got = {(r["tab"], r["rec_id"]): r["restored"].strip() for r in queries.p3_restored(spark, str(tmp_path)).collect()}
    assert set(got) == {("html_document", 1000), ("html_document", 1001), ("snapshot_meta", 7)}
    assert got["html_document", 1000] == good[0] and got["html_document", 1001].endswith(good[1]) and got["snapshot_meta", 7] == good[2]


def test_mojibake_empty(spark):
    df = spark.createDataFrame([], "tab string, rec_id bigint, text string")
    assert mojibake.find_damaged(df, mojibake.count_frequencies(df.select("text"))).count() == 0


def block_rows(seed=2, n=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        site = rng.choice(["a.example", "a.example", "b.example", "c.example"])
        text = rng.choice([f"Share this page {rng.randint(1, 9)} times", "All rights reserved here", "one two", "1 2 3 4", None, "", " ".join(rng.choice(WORDS) for _ in range(8))])
        rows.append((i, text, f"https://{site}/{rng.randint(1, 60)}", rng.choice([site, "www." + site.upper() + ":443", None]), rng.choice(["20200101000000", None]), rng.randint(1, 50)))
    return rows + rows[:30]


def test_site_lines_against_brute_force(spark):
    rows = block_rows()
    df = spark.createDataFrame(rows, BLOCK).withColumns({"site": F.lit("clash"), "h1": F.lit(1), "urls": F.lit(2)})
    pages, ids = {}, {}
    for b, t, u, *_ in rows:
        words = re.findall(r"[^\W_]+", re.sub("[0-9]+", "0", (t or "").lower()))
        if len(words) >= 3 and sum(any(c.isalpha() for c in w) for w in words) >= 2:
            key = (u.split("/")[2], tuple(words))
            pages.setdefault(key, set()).add(u)
            ids.setdefault(key, set()).add(b)
    want = {b for k, v in pages.items() if len(v) >= 10 for b in ids[k]}
    got = [r[0] for r in site_lines.find_site_lines(df).collect()]
    assert set(got) == want and len(got) == len(want)
    kept = site_lines.without_site_lines(df).collect()
    assert sum(r["blocks"] for r in kept) == len({b for b, t, *_ in rows if t is not None} - want)
    assert site_lines.find_site_lines(df.limit(0)).count() == 0


def test_residue(spark):
    rng = random.Random(4)
    lexicon = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(lexicon) for _ in range(n)).capitalize() + "."
    page = lambda *ps: "<body><main><article><h1>" + prose(5) + "</h1>" + "".join(f"<p>{p}</p>" for p in ps) + "</article></main></body>"
    good = [page(prose(30), prose(30)) for _ in range(60)]
    fine = [page(prose(20), f"Yesterday the portal of {prose(3)[:-1]} showed “404 Not Found” for hours, said the engineer who repaired it."), page(prose(9), "The club explains. <code>{{ page.title }}</code>"), "<noscript><p>Please enable JavaScript</p></noscript>" + page(prose(20))]
    bad = [page("Page not found"), page("{{ post.content }}"), page(prose(20), "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor."), "<body><noscript>You need to enable JavaScript to run this app.</noscript><div id='root'></div></body>", page(prose(8), f"{prose(6)} %user_name%")]
    rows = [(i, h) for i, h in enumerate([*good, *fine, *bad, None, ""])]
    df = spark.createDataFrame(rows + rows[-8:], "page_id bigint, html string")
    start = len(good) + len(fine)
    got = sorted(r[0] for r in residue.find_residue(df).collect())
    assert got == list(range(start, start + len(bad)))
    assert residue.find_residue(df.limit(0)).count() == 0


CASES = [
    ("New Pelho spoke to Dr. Devmoz about 3.5 % today. Then voters left at 5 p.m. Again it rained.", ["New Pelho spoke to Dr. Devmoz about 3.5 % today.", "Then voters left at 5 p.m.", "Again it rained."]),
    ('"Is it open?" asked Zup. She said: “It is. Come in.” Nobody came.', ['"Is it open?" asked Zup.', "She said: “It is. Come in.”", "Nobody came."]),
    ("Рада на вул. Шевченка діє.Після зборів, т. зв. нарада... тривала. Було 5 тис. грн. Потім усе.", ["Рада на вул. Шевченка діє.", "Після зборів, т. зв. нарада... тривала.", "Було 5 тис. грн.", "Потім усе."]),
    ("Title of it\r\n- one item\n2) two items\n\nEnd.", ["Title of it", "- one item", "2) two items", "End."]),
    ("Am 5. Juni war z. B. Markt. Der 3. Sitzung folgt nichts.", ["Am 5. Juni war z. B. Markt.", "Der 3. Sitzung folgt nichts."]),
    ("我们今年。代表说：“问题。解决！”医院（好吗？）公开？", ["我们今年。", "代表说：“问题。解决！”", "医院（好吗？）公开？"]),
    ("डॉ. सहयोग है। राय है । क्या है?", ["डॉ. सहयोग है।", "राय है ।", "क्या है?"]),
    ("الفريق د. المدينة قبل. الخطة؟ نعم", ["الفريق د. المدينة قبل.", "الخطة؟", "نعم"]),
    ("โปร่งใสชนบท ปัญหาโครงการ531 และเมือง\n1) ชุมชน", ["โปร่งใสชนบท", "ปัญหาโครงการ531", "และเมือง", "1) ชุมชน"]),
    ("Πόλη π.χ. ομάδα λύση; Έργο νέο.", ["Πόλη π.χ. ομάδα λύση;", "Έργο νέο."]),
    ("Քննարկում դպրոց։ Նիստ քաղաք՞ պլան։", ["Քննարկում դպրոց։", "Նիստ քաղաք՞ պլան։"]),
    ("See https://a.b/c?x=1.5 or mail info@kur.example in file_a.v2.pdf now!", ["See https://a.b/c?x=1.5 or mail info@kur.example in file_a.v2.pdf now!"]),
    ("K.H. Barr met L. Smith (did he?) there. The N.O.K. office… closed.", ["K.H. Barr met L. Smith (did he?) there.", "The N.O.K. office… closed."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentences(text)] == want


def test_abbreviation_by_its_own_document():
    text = "Im Haus xyz. kleine Dinge. Dort xyz. Mardo wartet."
    assert [text[a:b] for a, b in sentences.sentences(text)] == ["Im Haus xyz. kleine Dinge.", "Dort xyz. Mardo wartet."]


def test_sentence_learning_and_edges(spark):
    texts = [f"Im Haus xyz. Kuro {i} war es ruhig. Wir ruhig sahen xyz. Mard und xyz. kleine Dinge." for i in range(30)] + [None, "", " \n ", "a" * 100_000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, start_pos int")
    learned = sentences.learn_abbreviations(df)
    assert learned.get("xyz") is False
    got = sentences.split_sentences(df, learned=learned).collect()
    assert {r["doc_id"] for r in got} == {*range(30), 33}
    for r in got:
        piece = texts[r["doc_id"]][r["start_pos"] : r["end_pos"]]
        assert piece and piece == piece.strip()
    assert len([r for r in got if r["doc_id"] == 0]) == 2
    assert sentences.split_sentences(df.limit(0)).count() == 0


BLOCK = "block_id bigint, text string, url string, wayback_domain string, wayback_timestamp string, position int"


def line_rows(sites, prompts):
    """One block of unlike words on every url of every site, and the prompts: (text, site, urls)."""
    rows = [(f"ordinary words {site} number{i}x{i % 7} once", f"https://{site}/{i}", site) for site, n in sites.items() for i in range(n)]
    rows += [(text, f"https://{site}/{i}", site) for text, site, n in prompts for i in range(n)]
    letters = "abcdefghij"
    spelled = lambda t: re.sub(r"[0-9]+(?=x)", lambda m: "".join(letters[int(c)] for c in m.group()), t)
    return [(i, spelled(t), u, s, "20200101000000", 1) for i, (t, u, s) in enumerate(rows)]


@pytest.mark.parametrize("sites", [{"big.example": 3000, "small.example": 30}, {"big.example": 500}, {"a.example": 200, "b.example": 200, "c.example": 200, "d.example": 12}])
def test_site_lines_beside_a_dominant_site_and_alone(spark, sites):
    prompts = [("share this page now", s, 12) for s in sites] + [("seldom seen line here", s, 9) for s in sites]
    rows = line_rows(sites, prompts)
    got = {r[0] for r in site_lines.find_site_lines(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {r[0] for r in rows if r[1].startswith("share")}


def test_a_line_on_ten_urls_that_is_no_excess_stays(spark):
    # Every line of these sites is on eight or nine urls; eleven are no excess there, sixty are.
    lines = [(f"verse {'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]} of the song", s, 8 + i % 2) for s in ("a.example", "b.example") for i in range(100)]
    rows = line_rows({"a.example": 0}, [*lines, ("verse eleven of song", "a.example", 11), ("verse sixty of song", "a.example", 60)])
    got = {r[0] for r in site_lines.find_site_lines(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {r[0] for r in rows if "sixty" in r[1]}


def test_pages_without_site_lines_are_whole_captures(spark):
    prompts = [("share this page now", "a.example", 12)]
    rows = line_rows({"a.example": 40}, prompts)
    n = len(rows)
    more = [(n, "later", "https://a.example/1", "a.example", "20200101000000", 5), (n + 1, "other capture", "https://a.example/1", "a.example", "20210101000000", 1)]
    lone = [(n + 2 + i, f"no url {'xyz'[i]}", None, "a.example", None, None) for i in range(3)]
    crowd = [(1_000_000 + i, f"line {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}", "https://b.example/", None, None, None) for i in range(50)]
    got = site_lines.without_site_lines(spark.createDataFrame([*rows, *more, *lone, *crowd], BLOCK), segment=10).collect()
    assert len([r for r in got if r["url"] is None]) == 3 and all(r["blocks"] == 1 for r in got if r["url"] is None)
    assert sum(r["blocks"] for r in got) == 40 + 2 + 3 + 50 and all(r["blocks"] <= 10 for r in got)
    texts = {r["text"] for r in got if r["url"] == "https://a.example/1"}
    assert texts == {rows[1][1] + "\nlater", "other capture"}


SCRIPTS = {  # per script: a small word, a word with a capital, an abbreviation that is in no list, a name
    "latin": ("stone", "River", "qwzx", "Kurosz"),
    "cyrillic": ("камінь", "Ріка", "щжкв", "Ждурак"),
    "greek": ("πέτρα", "Ποτάμι", "ψξζβ", "Κουρόξ"),
    "armenian": ("քար", "Գետ", "ժծկղ", "Կուրոշ"),
    "coptic": ("ⲱⲛⲓ", "Ⲓⲁⲣⲟ", "ϫϭⲝⲯ", "Ⲕⲩⲣⲟⲥ"),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_made_up_abbreviations_and_names_by_their_document(script):
    small, cap, abbr, name = SCRIPTS[script]
    cut = lambda t: [t[a:b] for a, b in sentences.sentences(t)]
    shown = f"{cap} {abbr}. {small} {small}, {small} {name} {small}."
    assert cut(f"{shown} {cap} {abbr}. {name} {small}.") == [shown, f"{cap} {abbr}. {name} {small}."]
    assert cut(f"{cap} {small} {abbr}. {name} {small}.") == [f"{cap} {small} {abbr}.", f"{name} {small}."]  # without evidence a stop ends
    assert cut(f"{shown} {cap} {small}. {name} {small}.") == [shown, f"{cap} {small}.", f"{name} {small}."]


def test_a_listed_word_is_none_where_its_document_has_it_plain():
    cut = lambda t: [t[a:b] for a, b in sentences.sentences(t)]
    assert cut("The red car stood. Its door was red. Nobody came.") == ["The red car stood.", "Its door was red.", "Nobody came."]
    assert cut("Tu red. Kowal pisze.") == ["Tu red. Kowal pisze."]


def test_corpus_evidence_without_lists(spark, monkeypatch):
    for name in ("OPEN_ABBREVIATIONS", "CLOSING_ABBREVIATIONS", "BEFORE_ORDINAL"):
        monkeypatch.setattr(sentences, name, frozenset())
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [f"{say(4).capitalize()} абвг. {rng.randint(1, 99)} {say(3)}. Було {say(2)} о деже. {say(3).capitalize()}. Am {rng.randint(1, 30)}. Juni {say(2)}." for _ in range(60)]
    learned = sentences.learn_abbreviations(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    assert learned == {"абвг": False, "деже": True, "am #": False}
    cut = lambda t: [t[a:b] for a, b in sentences.sentences(t, learned)]
    assert cut("Тут абвг. Рада вийшла о деже. Школа діє am 5. Juni.") == ["Тут абвг. Рада вийшла о деже.", "Школа діє am 5. Juni."]


@pytest.mark.parametrize("piece", ["a.", "(", "“", "‘a’b", "a. ", ". ", "1. ", "a@", '"', "ж", "ก ", ".A"])
def test_sentences_of_a_megabyte_line(piece):
    import time

    text = piece * (600_000 // len(piece))
    began = time.perf_counter()
    got = sentences.sentences(text)
    sentences.corpus_counts([text])
    assert time.perf_counter() - began < 20 and all(0 <= a < b <= len(text) for a, b in got)


# No seed holds these; measured at 0.904 found.
UNSEEN_RESIDUE = (
    "Whoops! We can't seem to find that page.", "This page has moved. Please update your bookmarks.", "Error 410: the document was permanently removed from this server.", "The website encountered an unexpected error. Please try again later.",
    "Our servers are busy at the moment. Please reload in a few minutes.", "Database connection failed: timeout", "You must be logged in to view this content.", 
    "JavaScript must be turned on for this page to work.", "To use this website, please allow JavaScript in your browser.", "Loading failed. Please refresh the page and try again.", "Warning: Undefined array key in /var/www/app/view.php on line 61",
    "Fatal error: Uncaught TypeError: count() in /home/web/public_html/list.php:19 Stack trace: #0 {main} thrown", "Traceback (most recent call last): File \"views.py\", line 4, in index IndexError: list index out of range",
    "{{ entry.content_html }}", "{%= headline %}", "${pageContext.title}", "[[+article_intro]]", "%(author)s", "<<SUBTITLE>>", "{first_name} {last_name}", "%%HEADER%%", "@@BODY_TEXT@@",
    "Nunc feugiat mi a tellus consequat imperdiet; vestibulum sapien proin quam.", "Duis mollis est non commodo luctus, nisi erat porttitor ligula.", "Enter your description here", "Add your heading text here", "Insert your headline here", "Dummy text for this paragraph.",
    "Сторінка, яку ви шукаєте, не існує або була видалена.", "Сайт тимчасово недоступний, спробуйте зайти пізніше.", "Страница удалена или никогда не существовала.", "Die aufgerufene Seite existiert leider nicht.", "Der Server ist zurzeit nicht erreichbar.", "Szukana strona została usunięta lub przeniesiona.", "Serwis chwilowo niedostępny.",
    "该页面无法访问，请稍后再试。", "服务器维护中，请稍后再试", "Hmm, nothing here. The story you clicked on is gone.", "We're making some improvements and will return this afternoon.", "Bad gateway: the proxy received no answer", "This shop is currently closed. Please call again.",
    "Page load error. Press F5 to retry.", "System.IO.FileNotFoundException: Could not load file or assembly 'Site.Web' at Site.Global.Application_Start()", "Cannot read property length of null", "Mauris tincidunt sem sed arcu; nunc posuere, felis ut tempus gravida.",
    "#{page_heading}", "[% article.title %]", "{{> sidebar }}", "Write your introduction here", "Kein Zugriff auf diese Seite.", "Ups! Coś poszło nie tak. Spróbuj jeszcze raz.", "Помилка завантаження. Оновіть сторінку.",
)


def test_residue_never_seen_as_a_seed_against_english_prose():
    from pydoc_data import topics

    paragraphs = [" ".join(p.split()) for t in topics.topics.values() for p in t.split("\n\n")]
    long = [p for p in paragraphs if len(p) > 80 and p.count(" ") > 12 and not re.search(r"__|[{}<>%$@\\[\]|]", p)]
    background, other = long[::2], long[1::2]
    prose = [p for p in other if not re.search(r"[_{}<>%$@\[\]|/*=+]|\w\(|\w\.\w", p)]  # no code
    plain, shape = (sum(np.bincount(residue._grams(residue._codes(t, k)), minlength=residue.CELLS) for t in background).astype(float) for k in (False, True))
    tables = residue.ratio_tables(plain, shape)
    found = residue.is_residue(residue.coverage(list(UNSEEN_RESIDUE), tables))
    wrong = residue.is_residue(residue.coverage(prose, tables))
    assert found.mean() >= 0.9, [t for t, y in zip(UNSEEN_RESIDUE, found) if not y]
    assert wrong.mean() < 0.005, [t for t, y in zip(prose, wrong) if y]


def test_a_page_of_broken_noscript_is_read_in_linear_time():
    import time

    tables = residue.ratio_tables(np.zeros(residue.CELLS), np.zeros(residue.CELLS))
    began = time.perf_counter()
    residue.residue_pages(["<noscript>" * 50_000, "<noscript" * 50_000, "<script " * 50_000, "<head>" * 50_000], tables, main_text.main_tree())
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1251", "cp866", "koi8-u", "cp1250", "gbk"])
def test_texts_with_lost_bytes_come_back_through_every_reader(spark, read):
    good = titles(400)
    freq = mojibake.count_frequencies(spark.createDataFrame([(t,) for t in good], "text string"))
    restorer = mojibake.Restorer(freq)
    right = total = 0
    for t in good[:40]:
        got = restorer.restore(t.encode().decode(read, "replace"))[0]
        total += len(t.split())
        right += sum(a == b for a, b in zip(t.split(), got.split())) if len(t.split()) == len(got.split()) else 0
        assert restorer.restore(t) == (t, None)
    assert right / total >= 0.9
