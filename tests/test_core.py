"""Operators on small fixtures, nulls and empty tables included."""
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.functions import text as T
from pagewright.operators import clauses, decode, history, pages, repair, score, structure
from pagewright.operators.repair import Item, Sec, fold

PAGE = "doc_id BIGINT, page_no INT, pos INT, text STRING"
SUB = "sub_id BIGINT, doc_id BIGINT, sec_pos INT, sub_pos INT, id STRING, content STRING"


def col(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v STRING")
    return [r[0] for r in df.select(expr(df.v)).collect()]


def test_clause_ids(spark):
    text = "2.1. und 6.15.2.4 vom 1.12.2024 über 30.000.000 oder 3,5; 31.12. v2.7 aber 7.17.3, 9.9"
    assert col(spark, [text, None, ""], T.clause_ids) == [["2.1", "6.15.2.4", "31.12", "2.7", "9.9"], None, []]


def test_comps_and_neighbours(spark):
    assert col(spark, ["1.2.", " 3 ", "a", "", None, "1..2", "+1"], T.comps) == [[1, 2], [3], None, None, None, [1, 2], [1]]
    assert col(spark, ["2.1", "2.3.4", "1.2"], T.neighbours) == [["2.2"], ["2.3.3", "2.3.5", "2.3"], ["1.1", "1.3"]]


def test_trim_keeps_breaks(spark):
    assert col(spark, [" a b \t", "a \n", None], T.trim) == ["a b", "a \n", None]


def footed(n):
    return [(1, k + 1, k, f"Inhalt {'abcdefgh'[k]} steht hier\n2.7. 2.8.\nBlatt der Urkunde {k + 1}") for k in range(n)]


def test_furniture_first_stays(spark):
    out = pages.strip_furniture(spark.createDataFrame(footed(5), PAGE)).orderBy("pos").collect()
    assert [("Urkunde" in r.text) for r in out] == [True, False, False, False, False]
    assert all("2.7. 2.8." in r.text for r in out)


def test_furniture_small_and_blank(spark):
    p = spark.createDataFrame([*footed(2), (2, 1, 0, None), (2, 2, 1, "   "), (3, 1, 0, "a\r\nb")], PAGE)
    assert pages.furniture_keys(p).count() == 0
    assert {(r.doc_id, r.text) for r in pages.strip_furniture(p).collect()} == {(1, footed(2)[0][3]), (1, footed(2)[1][3]), (3, "a\nb")}
    i = {r.doc_id: (r.n_pages, r.has_text, r.needs_confirmation) for r in pages.inspect(p, large=1).collect()}
    assert i == {1: (2, True, False), 2: (2, False, True), 3: (1, True, False)}


def greedy(lengths, most):
    total = sum(lengths) + 2 * (len(lengths) - 1)
    if total <= most or len(lengths) == 1:
        return [0] * len(lengths)
    k = -(-total // most)
    target, no, cur, out = total // k + 1, 0, 0, []
    for n in lengths:
        if cur and cur + n > target and no < k - 1:
            no, cur = no + 1, 0
        cur += n + 2
        out.append(no)
    return out


@pytest.mark.parametrize("lengths", [[5], [30, 30, 30], [1, 90, 5, 40, 7], [10] * 17])
def test_chunks_greedy(spark, lengths):
    p = spark.createDataFrame([(1, k + 1, k, "x" * n) for k, n in enumerate(lengths)], PAGE)
    got = [r.chunk_no for r in pages.chunks(p, 50).orderBy("pos").collect()]
    assert got == greedy(lengths, 50)


def test_empty_tables(spark):
    p, s = spark.createDataFrame([], PAGE), spark.createDataFrame([], SUB)
    for df in (pages.strip_furniture(p), pages.chunks(p), pages.dump(p), clauses.source_ids(p), structure.items(p), structure.blocks(s), structure.duplicated_items(s)):
        assert df.count() == 0


def test_missing_and_invented(spark):
    p = spark.createDataFrame([(1, 1, 0, "1.1 a 1.2 b 1.3 c"), (1, 2, 1, "2.1 d 2.2 e 9.9 f 3 . 1 g")], PAGE)
    src = clauses.source_ids(p)
    lab = spark.createDataFrame([(1, "1.1"), (1, "1.3"), (1, "2.1"), (1, "2.2"), (1, "2.3"), (1, "3.1")], "doc_id BIGINT, id STRING")
    m = clauses.missing(src, lab)
    assert [r.id for r in m.collect()] == ["1.2"]
    inv = clauses.invented(src, lab, p)
    assert [r.id for r in inv.collect()] == ["2.3"]
    assert [tuple(r) for r in clauses.locations(m, p).collect()] == [(1, "1.2", 1)]
    assert {r.page_no for r in clauses.retry_pages(m, p).collect()} == {1, 2}
    want = "Missing from the result: clause 1.2{}. Not printed in the source: clause 2.3. Compare these places with the source or convert it again."
    assert clauses.warnings(m, inv).first().warning == want.format("")
    assert clauses.warnings(m, inv, places=clauses.locations(m, p)).first().warning == want.format(" (page 1)")


def test_blocks_and_restarts(spark):
    ids = ["1", None, "2", None, "1", "2", "3"]
    s = spark.createDataFrame([(k, 1, 0, k, i, "x") for k, i in enumerate(ids)], SUB)
    assert [r.block for r in structure.blocks(s).orderBy("sub_pos").collect()] == [0, 0, 0, 1, 1, 1, 1]
    assert [tuple(r) for r in structure.restarts(s).collect()] == [(1, 0, 4, 3)]


def test_duplicated_items(spark):
    rows = [(1, 1, 0, 0, None, "Alles über den Versicherungsschutz der Anlage"), (2, 1, 0, 1, "a", "den Versicherungsschutz"), (3, 1, 0, 2, "b", "kurz"), (4, 1, 0, 3, "(c)", None)]
    assert [r.sub_pos for r in structure.duplicated_items(spark.createDataFrame(rows, SUB)).collect()] == [1]


def test_items(spark):
    p = spark.createDataFrame([(1, 1, 0, "Vorspann\na. erster Punkt der Liste\nweiter im Ge-\ntext\nb. zweiter Punkt der Liste\n2.1 Klausel")], PAGE)
    out = structure.items(p).orderBy("line_no").collect()
    assert [(r.id, r.text) for r in out] == [("a", "erster Punkt der Liste weiter im Getext"), ("b", "zweiter Punkt der Liste")]
    assert out[1].anchor == out[0].key and out[0].anchor is None


def test_ladder(spark):
    good = '{"title":"A","reference":"B"}'
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, '{"title":"A\n","reference":"B"}'), (4, f"so: {good}."), (5, "nein"), (6, None)]
    out = {r.k: (r.rung, r.title) for r in decode.parse_ladder(spark.createDataFrame(rows, "k INT, s STRING"), "s").select("k", "rung", "answer.title").collect()}
    assert {k: v[0] > 0 for k, v in out.items()} == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False}
    assert out[1] == (1, "A") and out[4][1] == "A"


def test_history_and_retry(spark):
    h = spark.createDataFrame([("a", "/x/a.PDF", 2, None), ("a", "/x/a.PDF", 1, "w"), ("b", "/b", 3, None)], "name STRING, output_path STRING, ts INT, warning STRING")
    assert [(r.name, r.ts) for r in history.newest(h).collect()] == [("b", 3), ("a", 2)]
    parts = {r.output_path: (r.stem, r.extension, r.is_pdf) for r in history.path_parts(h, "output_path").collect()}
    assert parts["/x/a.PDF"] == ("a", "pdf", True) and parts["/b"] == ("b", "", False)
    a = spark.createDataFrame([("k", 1, 500), ("k", 2, 429), ("k", 3, 500)], "key STRING, attempt INT, code INT")
    assert [r.delay_s for r in history.retry_schedule(a).orderBy("attempt").collect()] == [3, 30, 45]


def test_word_recall(spark):
    d = spark.createDataFrame([(1, "Versicherungs-\nbedingungen und Grundstücksgrenze"), (2, None)], "k INT, t STRING")
    assert {r.word for r in score.long_words(d, "k", "t").collect()} == {"versicherungsbedingungen", "grundstücksgrenze"}


# -- repairs ------------------------------------------------------------------------------------

def item(token, ident, text, anchor=None, anchor_id=None):
    return Item(token, ident, text, fold(text)[:32], fold(anchor)[:32] if anchor else None, anchor_id)


A, B, C = "alles was zum Haushalt gehört", "bauliche Anlagen auf dem Grundstück", "Carports und offene Stellplätze"


def test_repair_inserts_in_chain():
    secs, lost = repair.repair_items([Sec("1", "X", [["a", A]])], [item("a.", "a", A), item("b.", "b", B, A), item("c.", "c", C, B)])
    assert [s[0] for s in secs[0].subs] == ["a", "b", "c"] and lost == []


def test_repair_splits_fused_and_counts_lost():
    secs, lost = repair.repair_items([Sec("1", "X", [["a", f"{A}; {B}"]])], [item("b.", "b", B, A), item("c.", "c", C, "steht nirgends im Text")])
    assert secs[0].subs == [["a", f"{A};"], ["b", B]] and [x.id for x in lost] == ["c"]


def test_repair_leaves_front_matter():
    secs, _ = repair.repair_items([Sec("", "", [["", f"Präambel {B}"]])], [item("b.", "b", B)])
    assert secs[0].subs == [["", f"Präambel {B}"]]


def test_repair_moves_misfiled():
    secs, _ = repair.repair_items([Sec("1", "X", [["a", A]]), Sec("2", "Y", [["b", B], ["a", C]])], [item("b.", "b", B, A)])
    assert [s[0] for s in secs[0].subs] == ["a", "b"] and [s[0] for s in secs[1].subs] == ["a"]


def scoped_case(line_above="Das war der letzte Satz."):
    subs = [["1", "Die erste Regel des Teils gilt."], ["2", "Die zweite Regel des Teils gilt. Zweiter Abschnitt"], ["1", "Neue Regel im zweiten Teil."], ["2", "Noch eine Regel im zweiten Teil."]]
    page = f"{line_above}\nZweiter Abschnitt\nNeue Regel im zweiten Teil.\nNoch eine Regel im zweiten Teil."
    return [Sec("A", "Teil", subs)], [page]


def test_scopes_split_and_idempotent():
    secs, heads = repair.split_scopes(*scoped_case())
    assert heads == ["Zweiter Abschnitt"] and [s.title for s in secs] == ["Teil", "Zweiter Abschnitt"]
    assert secs[0].subs[-1][1] == "Die zweite Regel des Teils gilt."
    assert repair.split_scopes(secs, scoped_case()[1])[0] == secs


@pytest.mark.parametrize("above", ["und der Rest der Zeile läuft", "siehe Anlage Nr."])
def test_scopes_need_a_closed_line(above):
    assert repair.split_scopes(*scoped_case(above))[1] == []


def test_rebind_swapped_numbers():
    one, two = "Versichert ist der Hausrat im Haus", "Nicht versichert sind Schäden durch Frost"
    secs, n = repair.rebind([Sec("1", "X", [["1.1", f"{one} {two}"], ["1.2", "am Ende."]])], [("1.1", one), ("1.2", two)])
    assert secs[0].subs == [["1.1", one], ["1.2", f"{two} am Ende."]] and n == 1
    same, n = repair.rebind([Sec("1", "X", [["1.1", one], ["1.2", two]])], [("1.1", one)])
    assert same[0].subs == [["1.1", one], ["1.2", two]] and n == 0


def test_sanitize_and_splice():
    run = [["2.1", "2.1 erste Klausel des Laufs"], ["2.2.", "zweite Klausel des Laufs"], ["3.1", "fremd"], ["2.3", ""]]
    good = repair.sanitize(run, "2", set())
    assert good == [["2.1", "erste Klausel des Laufs"], ["2.2", "zweite Klausel des Laufs"]]
    twice = [["1.1", "a b c"], ["1.2", "d e f"], ["1.1", "g h i"], ["1.3", "j k l"]]
    assert repair.sanitize(twice, "1", set()) is None
    assert [x[0] for x in repair.sanitize(twice, "1", {"1.3"})] == ["1.1", "1.3"]
    secs = [Sec("2", "X", [["1.9", "davor"], ["2.2", "erste Klausel des Laufs"], ["2.3", "zweite Klausel des Laufs"], ["2.9", "danach"]])]
    assert [s[0] for s in repair.splice(secs, good, "2")[0].subs] == ["1.9", "2.1", "2.2", "2.9"]
    assert repair.splice([Sec("5", "Y", [["5.1", "nichts"]])], good, "2") is None
    one = Sec("2", "X", [["2.1", "erste Klausel des Laufs"], ["2.9", "danach"]])
    assert repair.splice([one], good, "2") is None  # one match may be chance
    assert repair.splice([Sec("2", "X", [["", "erste Klausel des Laufs"], ["", "zweite Klausel des Laufs"]])], good, "2") is None
    assert repair.splice([Sec("", "Inhaltsverzeichnis", secs[0].subs)], good, "2") is None


def test_runs_adopted_one_by_one():
    texts = {f"1.{k}": f"Klausel Nummer {'abcdefg'[k]} des ersten Teils der Bedingungen" for k in range(1, 6)}
    secs = [Sec("1", "X", [["1.1", texts["1.1"]], ["1.3", texts["1.3"]]])]
    out, n = repair.adopt_runs(secs, {"1": [[i, t] for i, t in texts.items()]}, {"1.2", "1.4"})
    assert n == 1 and [i for i, _ in out[0].subs] == list(texts)
    assert repair.adopt_runs(secs, {"1": [["1.2", texts["1.2"]], ["1.3", texts["1.3"]]]}, {"1.2", "1.4"}) == (secs, 0)


def test_front_matter_recovered():
    intro = "Diese Bedingungen gelten für alle Verträge der Gesellschaft mit ihren Kunden."
    secs = repair.recover_front([Sec("1", "X", [["1", "Der erste Absatz des Vertrages."]])], [f"{intro}\n\nDer erste Absatz des Vertrages."])
    assert secs[0].subs == [["", intro]] and len(secs) == 2
    assert repair.recover_front(secs, [f"{intro}\n\nDer erste Absatz des Vertrages."]) == secs


subs_strategy = st.lists(st.tuples(st.sampled_from(["", "1", "2", "1.1", "1.2", "a"]), st.text("abc dé.\n", max_size=40)).map(list), max_size=8)


@settings(max_examples=60, deadline=None)
@given(subs_strategy, st.lists(st.tuples(st.sampled_from(["1", "2", "1.1", "1.2"]), st.text("abc dé", min_size=4, max_size=20)), max_size=6))
def test_rebind_keeps_text(subs, anchors):
    before = fold("".join(c for _, c in subs))
    secs, _ = repair.rebind([Sec("1", "X", subs)], anchors)
    assert fold("".join(c for _, c in secs[0].subs)) == before


@settings(max_examples=60, deadline=None)
@given(subs_strategy, st.text("abcdé ", min_size=12, max_size=30))
def test_repair_never_deletes(subs, text):
    secs, _ = repair.repair_items([Sec("1", "X", subs)], [item("b.", "b", text)] if len(fold(text)) >= 12 else [])
    assert len(fold("".join(c for s in secs for _, c in s.subs))) >= len(fold("".join(c for _, c in subs)))


def test_queue_fold_and_stream(spark, tmp_path):
    from pagewright.streaming import queue

    rows = [("p", 1, "add", "2020-01-01 00:00:00"), ("p", 2, "add", "2020-01-01 00:00:01"), ("p", 3, "start", "2020-01-01 00:00:02"), ("p", 4, "finish", "2020-01-01 00:00:09"), ("q", 1, "start", None)]
    df = spark.createDataFrame(rows, "path STRING, seq BIGINT, command STRING, t STRING").selectExpr("path", "seq", "command", "to_timestamp(t) AS ts")
    got = {r.path: (r.state, r.applied, r.ignored, str(r.finished_at)) for r in queue.fold(df).collect()}
    assert got["p"] == ("done", 3, 1, "2020-01-01 00:00:09") and got["q"][:3] == ("", 0, 1)


def test_oracles_match(spark):
    """Every query of the core against its SQL on the smallest tables."""
    import glob
    import os

    import duckdb
    import pandas as pd

    from pagewright.plans import catalog

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    oracle = catalog.oracle_sql()
    for name, q in catalog.queries().items():
        got = q(spark, d).toPandas()
        if name in oracle:
            want = c.execute(oracle[name]).df()
            cols = sorted(got.columns)
            assert cols == sorted(want.columns), name
            one = lambda v: None if v is None or pd.isna(v) else str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) else str(v)
            rows = lambda x: sorted(str([one(v) for v in r]) for r in x[cols].astype(object).itertuples(index=False, name=None))
            assert rows(got) == rows(want), name
