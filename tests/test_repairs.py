"""Cases of furniture, rendering, repairs and the conversion, in sentences of their own."""
import json
import random

from pagewright.functions import text as T
from pagewright.operators import clauses, pages, provider, render, repair, structure
from pagewright.operators.repair import Item, Sec, fold
from pagewright.plans import pipeline

PAGE = "doc_id BIGINT, page_no INT, pos INT, text STRING"
SUB = "doc_id BIGINT, sec_pos INT, sub_pos INT, id STRING, content STRING"
SEC = "doc_id BIGINT, sec_pos INT, id STRING, title STRING"
A, B, C = "Schäden an gemieteten Räumen", "Schäden durch Abwässer aller Art", "Schäden an geliehenen Geräten"


def item(token, ident, text, anchor=None, anchor_id=None):
    return Item(token, ident, text, fold(text)[:32], fold(anchor)[:32] if anchor else None, anchor_id)


def page_rows(spark, *texts):
    return spark.createDataFrame([(1, k + 1, k, t) for k, t in enumerate(texts)], PAGE)


def test_footer_of_changing_figures_stays_once(spark):
    foot = "Nordlicht Versicherung\nFassung {}/2019\nBlatt {} von 6\nTel. 0461 {}"
    p = page_rows(spark, *[f"Text der Seite {'abcdef'[k]} über den Schutz\n2.7. 2.8.\n(i)\n{foot.format(k, k, k)}" for k in range(6)])
    out = pages.strip_furniture(p).orderBy("pos").collect()
    assert len(out) == 6 and "Nordlicht" in out[0].text and not any("Nordlicht" in r.text or "Blatt" in r.text for r in out[1:])
    assert all("2.7. 2.8.\n(i)" in r.text and f"Seite {'abcdef'[r.pos]}" in r.text for r in out)
    two = page_rows(spark, foot, foot)
    assert [r.text for r in pages.strip_furniture(two).orderBy("pos").collect()] == [foot, foot]
    keys = pages.furniture_keys(p)
    refs = spark.createDataFrame([(1, "Nordlicht Versicherung Fassung 7/2019"), (1, "Aktenzeichen 17 K 4/20"), (2, "Nordlicht Versicherung"), (1, ""), (1, None)], "doc_id BIGINT, reference STRING")
    assert [r.furniture for r in pages.is_furniture(refs, "reference", keys).orderBy("doc_id", "reference").collect()] == [False, False, False, True, False]


ANSWER = ("answer_id INT, doc_id BIGINT, name STRING, title STRING, reference STRING, date STRING, notary STRING, annotations ARRAY<STRING>, signatures ARRAY<STRUCT<name STRING, role STRING>>, "
          "_markdown STRING, raw_response STRING")


def test_whole_document(spark):
    sec = spark.createDataFrame([(1, 0, "", ""), (1, 1, "1.", "1. Was gilt"), (1, 2, "Anhang", "Anhang zum Vertrag"), (1, 3, "1", "10 Tage")], SEC)
    sub = spark.createDataFrame([(1, 0, 0, "", "Träger: Nordlicht AG\nHafen"), (1, 0, 1, None, "ein Satz: ohne Label. Ja"), (1, 1, 0, "1.1.", "Haft- , Sach- und Geldschäden"), (1, 1, 1, "2", "2.500 Euro"), (1, 2, 0, "Teil B", "Teil B regelt dies"),
                                 (1, 2, 1, "Zusatz", "gilt daneben"), (1, 3, 0, "(i)", None)], SUB)
    body = render.sections_markdown(sec, sub)
    want = ("**Träger:** Nordlicht AG\nHafen\n\nein Satz: ohne Label. Ja\n\n## 1 Was gilt\n\n**1.1.** Haft-, Sach- und Geldschäden\n\n**2.** 2.500 Euro\n\n## Anhang zum Vertrag\n\nTeil B regelt dies\n\n"
            "**Zusatz.** gilt daneben\n\n## 10 Tage\n\n**(i).** ")
    assert body.first().markdown == want
    par = spark.createDataFrame([(1, 1, None, None, ""), (1, 0, "Ada Kern", "Mieterin", "Hafenweg 1")], "doc_id BIGINT, pos INT, name STRING, role STRING, details STRING")
    a = spark.createDataFrame([(1, 1, "datei", "Vertrag", "AZ 1", "Mai 2010", "N. Ort", ["gut"], [("Ada", "Mieterin"), (None, "Zeuge")], None, "{"), (2, 2, "datei", None, "", None, None, [], None, None, None),
                               (3, 1, "datei", "Vertrag", None, None, None, None, None, "roh", None)], ANSWER)
    out = {r.answer_id: r.markdown for r in render.document(a, "answer_id", body, render.parties_markdown(par)).collect()}
    assert out[1] == ("# Vertrag\n\n**Aktenzeichen:** AZ 1\n\n**Stand:** Mai 2010\n\n**Notar/in:** N. Ort\n\n## Beteiligte\n\n**Mieterin:** Ada Kern\n  Hafenweg 1\n\n**:** N/A\n\n" + want
                      + "\n\n---\n\n## Anmerkungen (Reviewer-Kommentare)\n\n- gut\n\n## Unterschriften\n\n- Ada — Mieterin\n- Zeuge\n\n## Raw Response\n\n{\n")
    assert out[2] == "# datei\n" and out[3] == "# datei\n\nroh"


def test_words_joined(spark):
    d = spark.createDataFrame([("Grund\u00ad \n stück",), ("Vor-\nsorge",), ("Vorsorgever-sicherung",), ("Spezial-Schaden",), ("Buß- und",)], "t STRING")
    assert [r[0] for r in d.select(T.dehyphenate("t")).collect()] == ["Grundstück", "Vorsorge", "Vorsorgeversicherung", "Spezial-Schaden", "Buß- und"]


def test_bare_numbers_that_the_pages_print(spark):
    p = page_rows(spark, "6.1 a 6.2 b 6.3 c 6.4 d 6.5 e\nversichert sind: 1. Wasser aus Rohren; 2) Hagel\xad\nkörner\nnach 6.9.3. Sturm und Blitz an Häusern")
    sec = spark.createDataFrame([(1, 0, "6.8", ""), (1, 1, "5.9", ""), (1, 2, "7.1", ""), (1, 3, "8", ""), (1, 4, "6", "")], SEC)
    sub = spark.createDataFrame([(1, 0, 0, "1.", "Wasser aus Rohren"), (1, 0, 1, "2", "HAGELkörner"), (1, 1, 0, "3", "Sturm und Blitz an Häusern"), (1, 2, 0, "1", "x y"), (1, 3, 0, "1", "ganz anderer Text hier")], SUB)
    src = clauses.source_ids(p)
    assert [r.section for r in clauses.bare_numbered(sec, sub, src, p).collect()] == ["5.9"]  # the tail of 6.9.3 vouches for nothing
    assert clauses.bare_numbered(sec, sub, src.limit(2), p).count() == 0


def test_letter_sections_fold(spark):
    secs = [Sec("1", "X", [["a", A], ["b", B]]), Sec("c.", C, [["", "und mehr"], ["d", "zuletzt"]]), Sec("e", "", [["", "Schluss"]]), Sec("2", "Y", [["2.1", "Text"]]), Sec("f", "steht allein", []), Sec("B", "groß", [])]
    got = repair.demote(secs)
    assert [(s.id, [i for i, _ in s.subs]) for s in got] == [("1", ["a", "b", "c", "d", "e"]), ("2", ["2.1"]), ("f", []), ("B", [])]
    assert got[0].subs[2] == ["c", f"{C}\nund mehr"]
    sec = spark.createDataFrame([(1, k, s.id, s.title) for k, s in enumerate(secs)], SEC)
    sub = spark.createDataFrame([(1, k, j, i, c) for k, s in enumerate(secs) for j, (i, c) in enumerate(s.subs)], SUB)
    flat = [(r.sec_pos, r.id, r.content) for r in structure.demoted(sec, sub).orderBy("sec_pos", "sub_pos").collect()]
    assert flat == [(0 if k == 0 else 3, i, c) for k, s in enumerate(got) for i, c in s.subs]


def test_item_goes_to_the_section_that_lacks_it():
    secs = [Sec("1.1", "X", [["a", A], ["b", B], ["c", C]]), Sec("1.2", "Y", [["a", "anderes"], ["b", B]])]
    out, lost = repair.repair_items(secs, [item("c.", "c", "Kosten der Rettung und Bergung", B, "b")])
    assert [i for i, _ in out[1].subs] == ["a", "b", "c"] and not lost
    two = [Sec("1", "X", [["a", A], ["(i)", f"{A} im Haus"], ["", "Rest"]])]  # of two places the one with the anchor's own id
    out, _ = repair.repair_items(two, [item("b.", "b", B, A, "a")])
    assert [i for i, _ in out[0].subs] == ["a", "b", "(i)", ""]


def test_roman_run_is_chained_and_keeps_brackets(spark):
    p = page_rows(spark, f"(i) {A}\n(ii) {B}\n(iii) {C}")
    its = structure.items(p).orderBy("line_no").collect()
    assert [(x.id, x.anchor_id) for x in its] == [("(i)", None), ("(ii)", "(i)"), ("(iii)", "(ii)")]
    out, lost = repair.repair_items([Sec("1", "X", [["(i)", A], ["2", "danach"]])], [Item(x.token, x.id, x.text, x.key, x.anchor, x.anchor_id) for x in its])
    assert [i for i, _ in out[0].subs] == ["(i)", "(ii)", "(iii)", "2"] and not lost


def test_prose_with_labelled_doubles():
    prose = f"Nicht gedeckt sind (i) {A} (ii) {B}"
    secs = repair.drop_duplicates([Sec("1", "X", [["a", prose], ["(i)", A], ["(ii)", B], ["Ab", A]])])
    assert [i for i, _ in secs[0].subs] == ["a", "Ab"]
    out, _ = repair.repair_items([Sec("1", "X", [["a", f"Nicht gedeckt sind {A} {B}"]])], [item("(i)", "(i)", A), item("(ii)", "(ii)", B, A, "(i)")])
    assert out[0].subs == [["a", "Nicht gedeckt sind"], ["(i)", A], ["(ii)", B]]
    assert repair.repair_items([Sec("1", "X", [["a", prose]])], [item("(i)", "(i)", A)])[0][0].subs == [["a", prose]]  # shown in the text


def test_front_matter_keeps_compounds_and_headings():
    intro = "Träger des Vertrages ist die Nordlicht AG, auch für Haus- und Grundbesitz der\nVersicher-\nten. Sie haftet den Kunden nach den folgenden Regeln und Sätzen"
    page = f"Inhaltsverzeichnis\n1\n12\n{intro}\n\n1 Erster Teil\nDer Schutz beginnt mit dem Tag der Zahlung."
    secs = repair.recover_front([Sec("1", "Erster Teil", [["1.1", "Der Schutz beginnt mit dem Tag der Zahlung."]])], [page])
    assert secs[0].subs == [["", "Träger des Vertrages ist die Nordlicht AG, auch für Haus- und Grundbesitz der Versicherten. Sie haftet den Kunden nach den folgenden Regeln und Sätzen"]]
    assert repair.recover_front(secs, [page]) == secs
    behind = [Sec("", "", [["", "Vorspann des Ganzen"]]), Sec("1", "T", [["1", "Der Schutz beginnt mit dem Tag der Zahlung."]]), Sec("", "", [["", "zwischen den Teilen steht dies"]])]
    assert repair.recover_front(behind, [page])[0].subs[0] == ["", "Vorspann des Ganzen"] and len(repair.recover_front(behind, [page])[0].subs) == 2


def test_decomposed_text_is_cut_right():
    import unicodedata
    nfd = unicodedata.normalize("NFD", f"Für Gebäude gilt: {A}; {B}")
    out, _ = repair.repair_items([Sec("1", "X", [["a", nfd]])], [item("b.", "b", B, A)])
    assert out[0].subs[1] == ["b", unicodedata.normalize("NFD", B)]


HEADS = "Das war der letzte Satz.\nSchiedsverfahren\n"


def scopes(*ids):
    return [Sec("3", "Teil", [[i, f"Regel {'abcdefghij'[k]} dieses Teils der Bedingungen"] for k, i in enumerate(ids)])]


def test_scopes():
    text = lambda k: f"Regel {'abcdefghij'[k]} dieses Teils der Bedingungen"
    page = "Erstes Ende des Satzes.\nKosten\n" + text(2) + "\n" + text(3) + ".\nVerfahren\n" + text(4) + "\n" + text(5)
    secs, heads = repair.split_scopes(scopes("1", "2", "1", "2", "1", "2"), [page])
    assert heads == ["Kosten", "Verfahren"] and [len(s.subs) for s in secs] == [2, 2, 2]
    assert repair.split_scopes(secs, [page]) == (secs, [])
    for ids in (("1", "2", "1", "3", "2"), ("1", "2", "3", "2"), ("1", "2", "1.1", "1.2"), ("1", "1")):
        assert repair.split_scopes(scopes(*ids), [page])[1] == []
    assert repair.split_scopes([Sec("", "Inhaltsverzeichnis", scopes("1", "2", "1", "2")[0].subs)], [page])[1] == []
    assert repair.split_scopes(scopes("1", "2", "1", "2"), [page, page.replace("Kosten", "Fristen")])[1] == []  # two headings
    assert repair.split_scopes(scopes("1", "2", "1", "2"), [page.replace("Kosten", "Kosten, Fristen")])[1] == []
    assert repair.split_scopes(scopes("2", "5", "3", "1", "2"), ["Ein Satz endet hier.\nKosten\n" + text(3)])[1] == ["Kosten"]  # a step back before it is no start


def test_restarts_veto(spark):
    sub = lambda *ids: spark.createDataFrame([(1, 0, k, i, "x") for k, i in enumerate(ids)], SUB)
    at = lambda *ids: sorted(r.sub_pos for r in structure.restarts(sub(*ids)).collect())
    assert at("1", "2", "1", "2", "1", "2") == [2, 4] and at("1", "2", "1", "3", "2", "1", "2") == [] and at("2", "5", "3", "1", "2") == [3]


def test_rebind_rejects_a_block_out_of_order():
    one, two = "Gedeckt ist der Verlust der Schlüssel", "Gedeckt ist auch der Bruch von Glas"
    block = [["1.1", f"{one} {two}"], ["1.2", "am Rand."]]
    assert repair.recut(block, [("1.1", two), ("1.2", one)]) is None
    assert repair.recut(block, [("1.1", one), ("1.1", two), ("1.2", "am Rand")]) is None
    assert [i for i, _ in repair.recut(block, [("1.1", one), ("1.2", two)])] == ["1.1", "1.2"]


def test_binding_is_taken_only_if_nothing_goes_missing():
    texts = {f"1.{k}": f"Klausel {'abcdefgh'[k]} über den Umfang des Schutzes im Haus" for k in range(1, 7)}
    page = "\n".join(f"{i} {t}" for i, t in texts.items())
    wrong = [Sec("1", "Umfang", [["1.1", texts["1.1"] + " " + texts["1.2"]], ["1.2", texts["1.3"]], ["1.3", texts["1.4"]], ["1.4", texts["1.5"] + " " + texts["1.6"]]])]
    secs, lost, split = pipeline.mend(wrong, [page], [], list(texts.items()), list(texts))
    assert [s for s in secs[0].subs] == [[i, t] for i, t in texts.items()] and not lost and not split
    assert pipeline.mend(wrong, [page * 9], [], list(texts.items()), list(texts))[0] == wrong  # too little of the source's text
    assert pipeline.missing_ids(list(texts), wrong) == {"1.5", "1.6"} and pipeline.missing_ids(["1.1", "1.2"], []) == set()


def test_conversion_loses_neither_ids_nor_text(spark):
    r = random.Random(3)
    words = "schutz haus garten frist zahlung schaden anzeige vertrag ende umfang regel dauer".split()
    sec, sub, page = [], [], []
    for d in range(1, 9):
        for s in range(3):
            sec.append((d, s, ["", "1", "2"][s], ["", "Umfang", "Ende"][s]))
            for k in range(4):
                sub.append((d, s, k, f"{s}.{k + 1}" if s else "", f"{r.choice(words).capitalize()} " + " ".join(r.choices(words, k=9)) + "."))
        page.append((d, 1, 0, "\n".join(f"{i} {c}" for dd, _, _, i, c in sub if dd == d)))
    gone = {(d, "1.2") for d in range(1, 5)}
    have = [x for x in sub if (x[0], x[3]) not in gone]
    out = {x.doc_id: x for x in pipeline.convert(spark.createDataFrame(page, PAGE), spark.createDataFrame(sec, SEC), spark.createDataFrame(have, SUB), reader=provider.Printed()).collect()}
    for d, _, _, i, c in sub:
        assert c in out[d].markdown and (not i or f"**{i}.** " in out[d].markdown)
    assert all(x.warning is None for x in out.values())
    bare = {x.doc_id: x.warning for x in pipeline.convert(spark.createDataFrame(page, PAGE), spark.createDataFrame(sec, SEC), spark.createDataFrame(have, SUB)).collect()}
    assert all(("clause 1.2 (page 1)" in (bare[d] or "")) == (d < 5) for d in bare)


def test_unreadable_answers_are_asked_again_and_in_halves(spark):
    class Flaky:  # its answers can't be read while the prompt is long
        def complete(self, system, prompt):
            return "success", "broken" if len(prompt) > 60 else json.dumps({"sections": [{"id": "1", "title": prompt[:5], "subsections": []}]}), 0

    p = page_rows(spark, "a" * 40, "b" * 40)
    out = provider.extract(p, Flaky(), most=200).orderBy("pos").collect()
    assert [(x.kind, x.answer.sections[0].title) for x in out] == [("success", "aaaaa"), ("success", "bbbbb")]
    one = provider.extract(page_rows(spark, "c" * 90), Flaky(), most=200).collect()
    assert [x.kind for x in one] == ["truncated"]  # a single page can't be halved
    stopped = provider.call(p.select("doc_id", "pos", p.text.alias("prompt")), provider.Echo(), stop=lambda: True).collect()
    assert {x.kind for x in stopped} == {"cancelled"}


def test_anchors_come_in_page_order(spark):
    p = page_rows(spark, "Inhaltsverzeichnis\n1.1 Umfang", "1.2 Zweite Regel hier\n1.1 Erste Regel hier", "ohne Ziffern", "1.3 Dritte Regel hier")
    a = provider.anchors(p, provider.Printed()).orderBy("pos").collect()
    assert [(x.id, x.start) for x in a] == [("1.2", "Zweite Regel hier"), ("1.1", "Erste Regel hier"), ("1.3", "Dritte Regel hier")]


def test_diagnostics_and_days(spark):
    from pagewright.operators import history
    h = spark.createDataFrame([(1, "a", "/a", "2020-05-04 23:30:00", None)], "doc_id BIGINT, name STRING, output_path STRING, t STRING, warning STRING").selectExpr("*", "to_timestamp(t) AS ts")
    assert history.diagnostics(h, "rejected", h.name).first().file == "2020-05-04T23:30:00-rejected.txt"
    assert [history.by_day(h, x).first().is_today for x in ("2020-05-04", "2020-05-05")] == [True, False]
