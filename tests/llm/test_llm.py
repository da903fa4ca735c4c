"""Operators on free text: brute force, round trips, held-out accuracy, and rows that are null, empty, repeated or odd."""
import math
import os
import random
import re
import unicodedata

import numpy as np
import pytest

from pagewright.llm import bpe, language, leakage, lookalike, personal, scans, sentences, truncation

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
TEXT = "id BIGINT, text STRING, canonical STRING"  # the last column's name clashes on purpose


def rows(spark, *pairs):
    return spark.createDataFrame([(i, t, "x") for i, t in pairs], TEXT)


# -- 6 encoding -----------------------------------------------------------------------------------

@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_encoding_matches_library_and_returns(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCABULARY)
    lib.encode_special_tokens = True
    r = random.Random(5)
    alphabet = "aaab  \n\n\t\r'sstT12²½٣äöß。中文　\xa0\x1c\x85!?.,-<|endoftext|>é̈​😀𝟘"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(600)] + ["a" * 5000, "Straße 12\n\n5  x " * 300]
    df = rows(spark, *[(k, t) for k, t in enumerate(texts)], (9000, None), (9001, ""), (9001, ""))
    got = [(x.doc_id, x.ids) for x in bpe.encode(df, "id", "text", VOCABULARY).collect()]
    assert len(got) == len(texts) + 3 and [i for k, i in got if k >= 9000] == [[], [], []]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    back = bpe.decode(VOCABULARY)
    for k, ids in got:
        if k < 9000:
            assert ids == want[k]
            assert b"".join(back[i] for i in ids).decode() == texts[k]


def test_automaton_equals_merging_by_hand():
    merges = [(b"a", b"a"), (b"a", b"b"), (b"aa", b"b"), (b"b", b"a"), (b"ab", b"ab")]
    vocab = {bytes([b]): b for b in range(256)} | {a + b: 256 + k for k, (a, b) in enumerate(merges)}
    auto = bpe.Automaton(vocab, merges)
    for n in range(1, 9):
        for code in range(2 ** n):
            w = bytes(b"ab"[code >> k & 1] for k in range(n))
            parts = [bytes([x]) for x in w]
            for a, b in merges:
                k = 0
                while k < len(parts) - 1:
                    if (parts[k], parts[k + 1]) == (a, b):
                        parts[k:k + 2] = [a + b]
                    k += 1
            assert auto.word(w) == [vocab[p] for p in parts], w


# -- 3 look-alikes --------------------------------------------------------------------------------

def test_look_alike_pairs_against_brute_force(spark):
    base = "Der Mieter zahlt 29 m² ab 2010."
    values = [base, base, base.replace("e", "е", 1), base.replace(" ", "\xa0"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in base), base[:4] + "​" + base[4:],
              base.replace("²", "2"), base.lower(), base.replace(" ", "\n", 1), "Prüfung", unicodedata.normalize("NFD", "Prüfung"), "Prufung", "", None, base.replace(" ", "  ", 1)]
    df = rows(spark, *list(enumerate(values)), (2, values[2]))
    got = {(r.id_a, r.id_b) for r in lookalike.same_look_pairs(df, "id", "text").collect()}
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if values[a] and values[b] and values[a] != values[b]
            and lookalike.visible_form(values[a]) == lookalike.visible_form(values[b])}
    assert got == want and {(0, 2), (0, 3), (0, 4), (0, 5), (9, 10)} <= got
    assert not any(6 in p or 7 in p or 8 in p or 14 in p for p in got)
    assert lookalike.same_look_pairs(rows(spark), "id", "text").count() == 0


def test_forms_are_those_of_each_value(spark):
    values = ["Straße m²", "Straße\xa0m²", "STRASSE M2", "a … b", "½", "ĳ", "plain text; „quoted“ – 5 €", "Ünïcödé ÿ", "ſ", "ª"]
    for r in lookalike.forms(rows(spark, *list(enumerate(values))), "text").collect():
        assert (r.canonical, r.visible) == (lookalike.canonical_form(r.text), lookalike.visible_form(r.text)), r.text


def test_forms_keep_settled_values(spark):
    f = {r.text: (r.canonical, r.visible) for r in lookalike.forms(rows(spark, (1, "Äpfel"), (2, "ＡＢ１"), (3, None), (4, "")), "text").collect()}
    assert f == {"Äpfel": ("äpfel", "Äpfel"), "ＡＢ１": ("ab1", "AB1"), "": ("", "")}


def test_classes_say_what_pairs_say(spark):
    r = random.Random(8)
    base = ["Miete zahlen", "Ｍiete zahlen", "Miete\u00a0zahlen", "miete zahlen", "Pacht", "Рacht", "Haus", "Garten"]
    data = [(k, r.choice(base)) for k in range(120)] + [(500, None), (501, ""), (3, "Haus")]
    df = rows(spark, *data)
    pairs = {(x.id_a, x.id_b) for x in lookalike.same_look_pairs(df, "id", "text").collect()}
    got = lookalike.classes(df, "id", "text").collect()
    form = {}
    for x in got:
        form.setdefault(x.form, set()).add(x.id)
    text = dict(data)
    assert {i for ids in form.values() for i in ids} == {i for p in pairs for i in p}
    assert all(any(set(p) <= ids for ids in form.values()) for p in pairs)
    assert all(x.n_rows == len([i for i in form[x.form]]) and x.n_spellings == len({text[i] for i in form[x.form]}) for x in got if 3 not in form[x.form])


# -- 5 sentences ----------------------------------------------------------------------------------

CASES = {
    "Es gilt Nr. 3 Abs. 2 S. 1. Am 4. Mai kostet es 3,50 EUR bzw. 1.000 EUR, z. B. bei Frost usw. Der Rest folgt!": 3,
    "Er sagte: „Das ist fertig. Mehr nicht.“ Danach ging er. Auf dem Blatt steht »Ja. Nein.« in Rot.": 3,
    "« Fini. Rien. » figure ici. Que faire ? À défaut, cf. art. 2 al. 3. Voilà.": 4,
    "Loss, e.g. at 5 p.m. in Annex 3, is excluded. “Fine. None.” must be signed. See Sec. 4.2 of www.x.test/a.b now.": 3,
    "借主は通知する。「完了した。異議はない。」と署名する。適用する！": 3, "यह लागू होगा। क्या देगा? हाँ।": 3, "لا تشمل. هل يتحمل المؤجر؟ نعم.": 3, "Ποιος πληρώνει; Το όριο είναι 3 κ.λπ. Τέλος.": 3,
    "ผู้เช่าแจ้งใน3วัน วงเงินไม่เกิน6ล้าน": 2, "A. Müller und Dr. K. Weber kamen. Sie blieben": 2, "ohne Ende": 1,
}


def test_sentence_counts_and_ends(spark):
    df = rows(spark, *list(enumerate(CASES)), (90, None), (91, " \n "), (92, ""), (93, "Ein Satz. " * 3000))
    got = {}
    for r in sentences.sentences(df, "id", "text").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.sentence, r.end_pos))
    for k, (text, n) in enumerate(CASES.items()):
        assert len(got[k]) == n, (text, got[k])
        assert got[k][-1][1] == len(text)
        at = 0
        for s, e in got[k]:
            assert text[at:e].strip() == s
            at = e
    assert 90 not in got and 91 not in got and 92 not in got and len(got[93]) == 3000


def test_quotations_of_any_length(spark):
    inner = "Das gilt immer. Nichts sonst! " * 400
    text = f"Er sagte: „{inner}Ende.“ Danach ging er. „{inner}"
    got = [x.sentence for x in sentences.sentences(rows(spark, (1, text)), "id", "text").orderBy("pos").collect()]
    assert got[0] == f"Er sagte: „{inner}Ende.“" and got[1] == "Danach ging er." and len(got) == 2 + 800


# -- 4 truncation -----------------------------------------------------------------------------------

def test_truncation_flags_cuts_only(spark):
    r = random.Random(1)
    words = "der Mieter zahlt die Miete an den Vermieter bis zum Ende des Monats ohne Abzug".split()
    sentence = lambda: " ".join(r.choice(words) for _ in range(r.randint(6, 14))).capitalize() + "."
    whole = [" ".join(sentence() for _ in range(r.randint(1, 9))) for _ in range(600)]
    cut = [" ".join(sentence() for _ in range(12))[:200] for _ in range(40)]
    data = [("f", k, "s", t) for k, t in enumerate(whole)] + [("f", 1000 + k, "t", t) for k, t in enumerate(cut)] + [("f", 2000 + k, "t", t) for k, t in enumerate(whole[:300])]
    data += [("f", 5000, None, None), ("f", 5001, "s", ""), ("f", 5002, "s", "des Erwerbers und"), ("f", 5003, "s", "Das Ende des Satzes ist da. Und hier fehlt…")]
    df = spark.createDataFrame(data, "field STRING, id BIGINT, source STRING, text STRING")
    out = {x.id: (x.cut, x.fixed_length) for x in truncation.truncated(df).collect()}
    ends_open = [1000 + k for k, t in enumerate(cut) if not t.endswith(".")]
    assert all(out[k] == (True, True) for k in ends_open)
    assert not any(out[k][0] for k in (*range(600), *range(2000, 2300), 5002)) and out[5003][0] and 5000 not in out and 5001 not in out
    h = truncation.hazards(df).where("significant").collect()
    assert {(x.source, x.len) for x in h} == {("t", 200)}
    assert truncation.truncated(spark.createDataFrame([], df.schema)).count() == 0


# -- 7 leakage ------------------------------------------------------------------------------------

def test_leakage_against_planted_passages(spark):
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(4000)]
    item = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, item(60), None) for k in range(30)] + [(99, None, "x")]
    docs, want = [], set()
    for k in range(400):
        body = item(150).split()
        if k % 4 == 0:
            i = k // 4 % 30
            part = items[i][1].split()[k % 30:k % 30 + 25]
            part[7], part[16] = "*****", "geändert"
            body[60:60] = part[:12] + ["Seite", "7", "von", "9"] + part[12:]
            want.add((k, i))
        elif k % 4 == 1:
            body[60:60] = items[k % 30][1].split()[:9]  # too short
        docs.append((k, " ".join(body), "y"))
    docs += [(500, None, "y"), (501, "", "y"), docs[0]]
    d = spark.createDataFrame(docs, "doc BIGINT, body STRING, item_id STRING")
    t = spark.createDataFrame(items, "item BIGINT, body STRING, doc_id STRING")
    got = [(x.doc_id, x.item_id) for x in leakage.found(d, "doc", "body", t, "item", "body").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert leakage.found(d.limit(0), "doc", "body", t, "item", "body").count() == 0
    assert leakage.found(d, "doc", "body", t.limit(0), "item", "body").count() == 0


def leak_tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc BIGINT, body STRING"), spark.createDataFrame(items, "item BIGINT, body STRING")


def leaked(spark, docs, items):
    d, t = leak_tables(spark, docs, items)
    return {(x.doc_id, x.item_id) for x in leakage.found(d, "doc", "body", t, "item", "body").collect()}


def test_leakage_of_short_and_very_long_items(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(9000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    long = text(6000)  # places beyond what one key held before
    items = [(1, "Sesamkringel"), (2, "zwei Sonderworte"), (3, long)]
    docs = [(k, text(60)) for k in range(50)]
    docs += [(100, f"{text(30)} sesamkringel {text(30)}"), (101, f"{text(30)} Zwei Sonderworte {text(9)}"), (102, f"{text(9)} zwei {text(40)} Sonderworte")]
    docs += [(103, f"{text(30)} {' '.join(long.split()[5000:5030])} {text(30)}"), (104, f"{text(10)} {' '.join(long.split()[4096:4120])}"), (105, "Sesamkringel")]
    assert leaked(spark, docs, items) == {(100, 1), (105, 1), (101, 2), (103, 3), (104, 3)}


def test_leakage_in_blocks_and_with_several_texts(spark):
    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, text(50)) for k in range(20)]
    docs = [(k, f"{text(40)} {' '.join(items[k % 20][1].split()[5:40])} {text(40)}") for k in range(60)] + [(0, text(100)), (0, f"{text(10)} {items[7][1]}")]
    want = {(k, k % 20) for k in range(60)} | {(0, 7)}
    assert leaked(spark, docs, items) == want
    old, leakage.MOST_ITEM_WORDS = leakage.MOST_ITEM_WORDS, 400
    try:
        assert leaked(spark, docs, items) == want
    finally:
        leakage.MOST_ITEM_WORDS = old


def test_leakage_candidates_against_brute_force(spark):
    """Every pair that the matching takes, tried on all pairs, must come out of the index."""
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(700)]
    text = lambda n: [r.choice(vocab[:60] if r.random() < .4 else vocab) for _ in range(n)]
    items = [(k, " ".join(text(r.randint(22, 70)))) for k in range(25)]
    docs = []
    for k in range(200):
        words = r.choice(items)[1].split()
        at = r.randint(0, len(words) - 21)
        part = [w if r.random() > .1 else r.choice(vocab) for w in words[at:at + r.randint(18, 40)]]
        cut = r.randint(0, len(part))
        docs.append((k, " ".join(text(30) + part[:cut] + (["Seite", "3"] if r.random() < .5 else []) + part[cut:] + text(30))))
    got = leaked(spark, docs, items)
    vocabulary, numbered = leakage._number(items)
    read = {d: np.array([vocabulary.get(leakage.fold(w), 0) for w in t.split()]) for d, t in docs}
    df = np.bincount(np.concatenate([np.unique(x) for x in read.values()]), minlength=len(vocabulary) + 1)
    idf = np.log((df[0] + 1) / (df + 1)) + 0.3
    brute = set()
    for d, x in read.items():
        at = np.flatnonzero(x)
        for i, ws in numbered.items():
            span, part, weight = leakage.chain(ws, x[at], at, idf)
            if span >= leakage.WINDOW and min(part, weight) >= leakage.SHARE:
                brute.add((d, i))
    assert len(brute) > 60 and got <= brute and len(got & brute) >= 0.98 * len(brute)


# -- 8 languages ----------------------------------------------------------------------------------

SAMPLES = {
    "de": "Der Beklagte hat die Klausel nicht gelesen und zahlt deshalb keine Miete an den Vermieter.", "en": "The defendant has not read the clause and therefore pays no rent to the landlord.",
    "fr": "Le défendeur n'a pas lu la clause et ne paie donc aucun loyer au bailleur cette année.", "es": "El demandado no ha leído la cláusula y por eso no paga ninguna renta al arrendador.",
    "it": "Il convenuto non ha letto la clausola e quindi non paga alcun canone al locatore.", "pt": "O réu não leu a cláusula e por isso não paga nenhuma renda ao senhorio este ano.",
    "nl": "De gedaagde heeft het beding niet gelezen en betaalt daarom geen huur aan de verhuurder.", "pl": "Pozwany nie przeczytał klauzuli i dlatego nie płaci żadnego czynszu wynajmującemu.",
}


def test_languages_found_and_labels_read(spark):
    r = random.Random(2)
    train = []
    for k in range(400):
        lang = sorted(SAMPLES)[k % 8]
        w = SAMPLES[lang].rstrip(".").split()
        text = " ".join(" ".join(r.sample(w, len(w))).capitalize() + "." for _ in range(6))
        train.append((k, text, lang if k % 11 else "de"))  # some labels are wrong
    df = spark.createDataFrame(train, "id BIGINT, text STRING, lang STRING")
    model = language.fit(df, "id", "text", "lang")
    tests = [(k, " ".join([t] * 3), "und") for k, t in enumerate(SAMPLES.values())]
    tests += [(20, f"{SAMPLES['de']} {SAMPLES['de']}\n{SAMPLES['pl']} {SAMPLES['pl']}\n{SAMPLES['de']}", "de_AT"), (21, f"{SAMPLES['de']} {SAMPLES['de']} {SAMPLES['en']}", "German"), (22, None, "de"), (23, " \n", ""), (24, "12 34.", None)]
    t = spark.createDataFrame(tests, "id BIGINT, text STRING, lang STRING")
    got = {(x.doc_id, x.lang) for x in language.present(t, "id", "text", "lang", model).where("label IS NULL OR label <> lang").collect()}
    assert got == {(k, g) for k, g in enumerate(SAMPLES)} | {(20, "pl")}
    seg = [x.lang for x in language.spans(t.where("id = 20"), "id", "text", model).orderBy("pos").collect()]
    assert seg == ["de", "pl", "de"]
    assert language.present(t.limit(0), "id", "text", "lang", model).count() == 0
    empty = language.fit(t.limit(0), "id", "text", "lang")
    assert language.present(t.limit(0), "id", "text", "lang", empty).count() == 0


def test_sample_is_exact_and_bounded(spark):
    docs = [(k, f"{SAMPLES['de']} Nummer {k}.", "de") for k in range(5000)] + [(k, SAMPLES["pl"], "pl") for k in range(6000, 6040)]
    docs += [(7, SAMPLES["de"], "de")] * 3000 + [(9000, SAMPLES["it"], "it")] * 2000 + [(9001, None, "it"), (9002, "x " * 50_000, "it")]
    df = spark.createDataFrame(docs, "id BIGINT, text STRING, lang STRING")
    hashes = {r.id: r.h for r in df.select("id").distinct().selectExpr("id", "xxhash64(CAST(id AS STRING)) AS h").collect()}
    got = language.sample(df.repartition(7), "id", "text", "lang")
    ids = lambda lang: {int(r[2]) for r in got if r[0] == lang}
    assert ids("de") == set(sorted(range(5000), key=lambda k: hashes[k])[:language.SAMPLE_DOCS])
    assert ids("pl") == set(range(6000, 6040)) and ids("it") == {9000, 9002} and len(got) == language.SAMPLE_DOCS + 42
    assert got == language.sample(df.repartition(3), "id", "text", "lang") and all(len(r[3]) <= language.SEGMENTS_READ for r in got)


# -- 1 personal information -------------------------------------------------------------------------

def test_personal_held_out_and_rest_unchanged(spark):
    given = [g.lower() for g in personal._GIVEN]
    model = personal.Model(set(given), personal.fit(personal.Lexicon(set(given))))
    r = random.Random(77)
    wrong = 0
    for _ in range(500):
        text, gold = personal._example(r)
        wrong += {k for *_, k in gold} != {k for *_, k in model.entities(text)}
    assert wrong < 15
    text = "Nach Angaben von Greta Bergfeld, wohnhaft Gartenstraße 12a, 12345 Altbruck, Tel. 0221-4710-888, wurde am 04.05.2006 die Police KV-000123456 geschlossen."
    assert personal.redact(text, model) == text.replace("Greta Bergfeld", "[NAME]").replace("Gartenstraße 12a", "[ADDRESS]").replace("0221-4710-888", "[PHONE]")
    wide = text.replace("Greta", "Gre​ta")
    assert "[NAME]" in personal.redact(wide, model) and personal.redact(wide, model).endswith("geschlossen.")
    src = spark.createDataFrame([("f", 1, text), ("f", 1, text), ("f", 2, None), ("f", 3, "x" * 20000), ("g", 1, "Greta Bergfeld")], "field STRING, row_id BIGINT, text STRING")
    got = {(x.field, x.row_id, x.kind) for x in personal.found(src, model).collect()}
    assert got == {("f", 1, "name"), ("f", 1, "address"), ("f", 1, "phone"), ("g", 1, "name")}
    out = personal.redacted(src, model).collect()
    assert len(out) == 5 and [x.text for x in out if x.row_id == 2] == [None]
    assert personal.found(src.limit(0), model).count() == 0


def test_personal_with_names_and_sentences_of_its_own(spark):
    """Names, streets and sentences that the fit has not seen; given names are learnt from the column of names."""
    given, last = "Zygmunt Odalys Thorvald Ximena Bertille Nepomuk".split(), "Quastenberg Ollerich Vandenhoff Szabados Trumpfheller Jovanovic".split()
    streets, firms = ["Rabensteiner Chaussee", "Kupferschmiedgasse", "Auf der Lohe", "Alter Postweg", "Fliederring"], ["Ollerich & Töchter GmbH", "Vandenhoff Reederei AG"]
    r = random.Random(12)
    d = lambda n: "".join(r.choice("123456789") for _ in range(n))
    names = spark.createDataFrame([(f"{g} {x}",) for g in given for x in last[:3]], "name STRING")
    model = personal.learn(names, "name")
    make = {"name": lambda: f"{r.choice(given)} {r.choice(last)}", "address": lambda: f"{r.choice(streets)} {d(2)}", "phone": lambda: f"0{d(3)}/{d(6)}", "email": lambda: f"{d(1)}kontakt.{r.choice(last).lower()}@seeblick.example",
            "idnum": lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}", "": lambda: r.choice(firms)}
    frames = [("Das Protokoll führte {} an diesem Abend.", "name"), ("Mit Schreiben vom Montag erklärt {} den Rücktritt.", "name"), ("Die Schlüssel liegen bei {} im Büro.", "name"), ("Übergeben wird die Wohnung {} in 10245 Krähenwinkel.", "address"),
              ("Lieferungen gehen an die Anschrift {}, 20457 Möwenort.", "address"), ("Rückfragen bitte unter Telefon {} am Vormittag.", "phone"), ("Wer Fragen hat, schreibt an {} bis Freitag.", "email"), ("Die Steuer-ID {} ist im Antrag zu nennen.", "idnum"),
              ("Die Firma {} liefert alle Teile.", ""), ("Der Vertrag mit {} endet im Mai.", "")]
    right = wrong = missed = 0
    for _ in range(400):
        frame, kind = r.choice(frames)
        got = {k for *_, k in personal.analyse(frame.format(make[kind]()), model)}
        right += kind in got
        missed += bool(kind) and kind not in got
        wrong += len(got - {kind})
    assert right / (right + missed) > 0.95 and right / (right + wrong) > 0.95


def test_decoding_and_expectations_against_all_sequences():
    r = random.Random(1)
    for _ in range(200):
        cands = sorted({(a := r.randint(0, 20), a + r.randint(1, 12), r.choice(["name", "phone"]), (f"f{r.randint(0, 3)}",)) for _ in range(r.randint(1, 6))})
        weights = {x: r.uniform(-2, 2) for x in [*(f"f{k}" for k in range(4)), *(f"{a}>{b}:{g}" for a in ("name", "phone") for b in ("name", "phone") for g in ("near", "far")), "^>name", "^>phone"]}
        every = [[]]
        for i, c in enumerate(cands):
            every += [[*q, i] for q in every if not q or cands[q[-1]][1] <= c[0]]
        features = lambda q: [x for n, i in enumerate(q) for x in (*cands[i][3], personal._pair(cands[q[n - 1]] if n else None, cands[i]))]
        score = lambda q: sum(weights[x] for x in features(q))
        best = max(every, key=score)
        got = personal.decode(cands, weights)
        assert sum(got == [cands[i][:3] for i in q] and abs(score(q) - score(best)) < 1e-9 for q in every) >= 1
        total = sum(math.exp(score(q)) for q in every)
        wanted = r.choice(every)
        want = {}
        for q in every:
            for x in features(q):
                want[x] = want.get(x, 0) - math.exp(score(q)) / total
        for x in features(wanted):
            want[x] = want.get(x, 0) + 1
        grad = personal._expected(cands, set(wanted), weights)
        assert all(abs(grad.get(x, 0) - v) < 1e-6 for x, v in want.items())


def test_rare_given_names_are_joined(spark):
    names = spark.createDataFrame([(n,) for n in ["Greta Bergfeld"] * 5 + ["Odalys Dahlmann", "Ximena-Rosa Fichtner"]], "name STRING")
    old, personal.LEXICON = personal.LEXICON, 1
    try:
        model = personal.learn(names, "name")
    finally:
        personal.LEXICON = old
    assert model.lex.given == {"greta"} and {r.g for r in model.rest.collect()} == {"odalys", "ximena-rosa"}
    src = spark.createDataFrame([("f", 1, "Nach Angaben von Odalys Erlbach, wohnhaft Birkenweg 4."), ("f", 2, "Erschienen ist Ximena-Rosa Imhofen, 12."), ("f", 3, "Erschienen ist Greta Imhofen."), ("f", 4, "Kein Name hier."), ("f", 5, None)],
                                "field STRING, row_id BIGINT, text STRING")
    assert {x.row_id for x in personal.found(src, model).where("kind = 'name'").collect()} == {1, 2, 3}
    assert {x.row_id: x.text for x in personal.redacted(src, model).collect()}[2] == "Erschienen ist [NAME], 12." and personal.redacted(src, model).count() == 5


# -- 2 scans --------------------------------------------------------------------------------------

def test_scans_kinds_and_repair(spark):
    clean = ["Der Mieter zahlt die Miete binnen vier Wochen an den Vermieter.", "Die Kündigung bedarf der Textform und einer Frist von vier Wochen."] * 60
    bad = {1000: "Der Mietcr zahlt die Miete binnen vier\nWochen an den Ver-\nmieter.", 1001: "Der Mieter zahlt\nSeite 3 von 5\ndie Miete.", 1002: "Die Kündigung bedarf\nPachtvertrag | Stand 09/2011\nder Textform.",
           1003: "Staffel in Tausend EUR:\n150\n300", 1004: "Haus-\nund Grundbesitz", 1005: "Zur Kfz-\nHaftpflicht", 1006: None, 1007: ""}
    df = rows(spark, *list(enumerate(clean)), *bad.items(), (1000, bad[1000]))
    got = {(x.id, x.kind) for x in scans.found(df, "id", "text").collect()}
    assert got == {(1000, "misread"), (1000, "hyphen"), (1001, "pageno"), (1002, "header")}
    fixed = {x.id: x.text for x in scans.repaired(df, "id", "text").collect()}
    assert fixed[1000] == "Der Mieter zahlt die Miete binnen vier Wochen an den Vermieter." and fixed[1001] == "Der Mieter zahlt die Miete."
    assert scans.found(df.limit(0), "id", "text").count() == 0


def test_vectors_put_like_words_together():
    pairs = [(a, b, 50.0) for a in (0, 1) for b in (4, 5)] + [(a, b, 50.0) for a in (2, 3) for b in (6, 7)]
    pairs += [(b, a, n) for a, b, n in pairs]
    w, _, part = scans.vectors(pairs, 8)
    assert part.sum() == pytest.approx(1) and not scans.vectors(pairs, 8, negatives=5)[0].any()  # these pairs are no more frequent than that shift asks
    cos = lambda a, b: float(w[a] @ w[b] / np.linalg.norm(w[a]) / np.linalg.norm(w[b]))
    assert cos(0, 1) > 0.9 > abs(cos(0, 2))


def scanned(n):
    """Texts with a header at different places, and as many copies of a wrapped clause whose lines look like one."""
    words = "mieter vermieter frist miete monat textform zugang haus garten keller zahlung abrede nutzung mangel schaden anzeige".split()
    r = random.Random(8)
    body = lambda: [" ".join(r.choice(words) for _ in range(6)) for _ in range(3)]
    head = [(k, f"Die {(b := body())[0]}\n{b[1]}\nRahmenvertrag Wartung{f' – Seite {k}' if k % 2 else ''}\n{b[2]}.") for k in range(n)]
    clause = "Nach dem {} gilt dies.\nZur Haus- und Grundbesitzerhaftpflicht zählt die Kfz-\nHaftpflicht nicht, wohl aber die Deckung\nzum Neuwert, sofern dies {} ist."
    return head, [(1000 + k, clause.format(r.choice(words), r.choice(words))) for k in range(n)]


def test_lines_of_copied_clauses_are_no_headers(spark):
    head, prose = scanned(40)
    got = {(x.id, x.kind) for x in scans.found(rows(spark, *head, *prose), "id", "text").collect()}
    assert {i for i, k in got if k == "header"} == {i for i, _ in head}
    fixed = {x.id: x.text for x in scans.repaired(rows(spark, *head, *prose), "id", "text").collect()}
    assert all("Haftpflicht nicht, wohl aber die Deckung zum Neuwert" in fixed[i] for i, _ in prose)


def test_repair_drops_headers_with_page_numbers(spark):
    head, prose = scanned(40)
    fixed = {x.id: x.text for x in scans.repaired(rows(spark, *head, *prose), "id", "text").collect()}
    assert not any("Rahmenvertrag" in fixed[i] for i, _ in head)


def test_repair_corrects_in_context_only(spark):
    r = random.Random(4)
    a, b = "mieter vermieter zahlung frist".split(), "garten hecke baum rasen".split()
    one = lambda ws, mid: " ".join([*r.choices(ws, k=3), mid, *r.choices(ws, k=3)])
    clean = [one(a, "Kündigung") for _ in range(200)] + [one(b, "Wiese") for _ in range(200)]
    bad = {1000: "mieter zahlung Kündi-\ngnng frist mieter\nEnde hier", 1001: "garten hecke Kündigunq rasen baum\nEnde hier"}
    fixed = {x.id: x.text for x in scans.repaired(rows(spark, *list(enumerate(clean)), *bad.items()), "id", "text").collect()}
    assert fixed == dict(enumerate(clean)) | {1000: "mieter zahlung Kündigung frist mieter Ende hier", 1001: "garten hecke Kündigunq rasen baum Ende hier"}
    assert scans._corrected("Mietcr 3!Mietcr und Mietcr", {("Mietcr", 1): "Mieter"}) == "Mietcr 3!Mieter und Mietcr"


def test_links_find_plausible_misreadings(spark):
    """Recall of the links: words with one to three glyphs mistaken, against the words that they were."""
    r = random.Random(3)
    words = ["".join(r.choice("abdeghilmnorstuvwz") for _ in range(r.randint(6, 11))) for _ in range(150)]
    edits = [(v, k) for k, v in scans.GLYPHS.items() if len(k) == 1 and k not in "|!"] + [("m", "rn"), ("e", "c"), ("h", "b")]
    bad = {}
    for w in words:
        x = w
        for a, b in r.sample(edits, len(edits)):
            if a in x and sum(p != q for p, q in zip(x, w)) < 3:
                x = x.replace(a, b, 1)
                if r.random() < .6:
                    break
        if x != w:
            bad[x] = w
    counts = [("word", w, 5000) for w in words] + [("word", x, 3) for x in bad]
    link = {x.word: x.target for x in scans.links(spark.createDataFrame(counts, "kind STRING, word STRING, n BIGINT"), 100_000).collect()}
    assert len(bad) > 100 and sum(link.get(x) == w for x, w in bad.items()) >= 0.9 * len(bad)


def test_vectors_judge_targets_that_are_not_common(spark):
    """A target below the share of a common word is judged by its own pairs with common words."""
    r = random.Random(4)
    a, b = "mieter vermieter zahlung frist".split(), "garten hecke baum rasen".split()
    one = lambda ws, mid: " ".join([*r.choices(ws, k=3), mid, *r.choices(ws, k=3)])
    clean = [one(a, "Kündigung") for _ in range(200)] + [one(b, "Wiese") for _ in range(200)] + [" ".join(r.choices(a if k % 2 else b, k=60)) for k in range(9000)]
    bad = {100000: "mieter zahlung Kündigunq frist mieter\nEnde hier", 100001: "garten hecke Kündigunq rasen baum\nEnde hier"}
    df = rows(spark, *list(enumerate(clean)), *bad.items())
    assert 200 < scans.COMMON * sum(len(t.split()) for t in [*clean, *bad.values()]) * 5 and 200 / (9000 * 60) > scans.FREQUENT
    old, scans.COMMON = scans.COMMON, 1e-3
    try:
        assert {x.id for x in scans.found(df, "id", "text").collect()} == {100000}
    finally:
        scans.COMMON = old


def test_one_header_in_most_texts(spark):
    head, _ = scanned(300)  # one key for all texts
    got = {x.id for x in scans.found(rows(spark, *head), "id", "text").where("kind = 'header'").collect()}
    assert got == {i for i, _ in head}


def test_all_segments_come_out(spark, tmp_path):
    from pagewright.llm import queries

    docs = [(k, " ".join([SAMPLES[lang]] * 4), lang) for k, lang in enumerate(sorted(SAMPLES) * 10)]
    docs.append((500, SAMPLES["de"] + "\n" + SAMPLES["pl"].rstrip("."), "de"))  # a quotation without a closing mark
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(x.lang, x.sentences) for x in queries.p8_segments(spark, str(tmp_path)).where("doc_id = 500").orderBy("pos").collect()]
    assert got == [("de", 1), ("pl", 0)]


def test_hints_lose_no_shape():
    lex = personal.Lexicon({"greta", "leroy", "jean-pierre"})
    model = personal.Model(lex.given, personal.fit(lex))
    cases = {"phone": ["Tel. 01.23.45.67.89", "Tel. 030.12.34.56.78", "Tel. 0049 (0)89 1234567", "Tel. 089\xa01234567"],
             "address": ["wohnhaft Gartenstraße\xa012", "wohnhaft Lindenhain 12\n54321 Altbruck", "wohnhaft Lindenhain 12 54321 Altbruck", "12, bis rue de Lyon"],
             "idnum": ["Steuer-ID 12\xa0345\xa0678\xa0901", "Steuer-ID 12 345\n678 901"],
             "name": ["Frau Šimić Novak", "J. Łuczak", "Herr Leroy Bergfeld", "LeRoy Bergfeld", "Jean-Pierre Bergfeld", "Bergfeld, J. 12"]}
    for kind, texts in cases.items():
        for t in texts:
            flat = personal._wrapped.sub(" ", t)
            assert kind in {k for _, _, k, _ in personal.candidates(flat, lex)}, t
    for t in [*cases["phone"], *cases["address"][:3], *cases["idnum"], *cases["name"][1:2]]:
        assert personal.analyse(t, model), t
    r = random.Random(6)
    bits = [*"0 0 0 1 1 12 123 54321 123456 + ( ) (0) . , / - – @ X. M. CFGHJKLMN A1".split(), " ", " ", " ", "\n", "’", "Frau", "Herr", "Dr.", "von", "Šimić", "Łuk", "ŁUK", "GRETA", "Weg",
            "Am", "Ring", "rue", "ter", "Lane", "Old", "in", "a", "mail", "(at)"]
    for _ in range(30000):
        t = "".join(r.choice(bits) + r.choice(["", "", " "]) for _ in range(r.randint(2, 12)))
        assert set(personal._spots(t, lex)) == every_spot(t, lex), t


def every_spot(s, lex):
    """What the shapes match, whatever the hints say."""
    out = {(m.start(), m.start() + len(personal._stop(m.group())[0].rstrip("./- ")) if k == "phone" else m.end(), k, f"{k}:{n}")
           for k, ps in personal.SHAPES.items() for n, p in enumerate(ps) for m in re.finditer(p, s)}
    out |= {(*m.span(), "name", f"name:{x}") for x, p in (("titled", personal._titled), ("initial", personal._initial)) for m in p.finditer(s)}
    for m in personal._words.finditer(s):
        if m.group()[0].isupper() and lex.has(m.group()):
            a, b = m.span()
            lead = personal._lead_title(s[:a])
            if rest := personal._rest(s, b):
                out.add((lead.start() if lead else a, rest.end(), "name", "name:given"))
            if turned := personal._turned(s[max(0, a - 60):a]):
                out.add((max(0, a - 60) + turned.start(), b, "name", "name:turned"))
    return out


def test_limit_of_a_source_cuts_whatever_the_end(spark):
    r = random.Random(2)
    words = "mieter zahlt miete vermieter ende monat abzug frist garten keller".split()
    body = lambda n: " ".join(r.choice(words) for _ in range(n))
    clause = lambda: f"Die Deckung gilt {body(50)}."
    data = [("f", k, "hot", clause()[:120]) for k in range(40)]  # cut copies outnumber the whole ones
    data += [("f", 100 + k, "hot", f"{body(30)[:119]},") for k in range(8)] + [("f", 200 + k, "ok", clause()) for k in range(6)]
    data += [("f", 300 + k, "hot", f"{body(r.randint(2, 9)).capitalize()}.") for k in range(60)]
    data += [("f", 400 + k, "ok", f"infolge der Nutzung von {w}," ) for k, w in enumerate(["Räumen", "Wiesen", "Wegen?"[:5] + "n", "Türmen"] * 5)]
    data += [("f", 500 + k, "ok", f"{body(r.randint(2, 30)).capitalize()}.") for k in range(200)]
    df = spark.createDataFrame(data, "field STRING, id BIGINT, source STRING, text STRING")
    out = {x.id: x.cut for x in truncation.truncated(df).collect()}
    assert {k for k, c in out.items() if c} == {*range(40), *range(100, 108)}

