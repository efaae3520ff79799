"""Small cases of the operators on text: results, nulls, empty and long texts, ties, repeated rows, empty tables."""

from datetime import datetime

import pytest

from quirelight.llm import charforms, encode, langid, mixing, mojibake, reading, scanfix, sentences, sitelines

T0 = datetime(2024, 1, 1)


def rows(df):
    return {tuple(r) for r in df.collect()}


# ---- 1

SAME = [("ｏｆ", "of"), ("t​he", "the"), ("café", "café"), ("саt", "cat"), ("ﬁnd", "find"), ("a b", "a b"), ("Ⅳ", "IV"), ("⽬", "目"), ("﻿x ", "x"), ("Ås", "Ås"), ("Τhe", "The"), ("hand‐made", "hand-made")]
OTHER = [("The", "the"), ("é", "e"), ("a–b", "a-b"), ("“a", '"a'), ("12 kg", "12kg"), ("x²", "x2"), ("①", "1"), ("Ã©", "é"), ("Daſ", "Das"), ("ı", "i"), ("½", "1/2"), ("№", "No"), ("a", None), ("​", "‌")]


@pytest.mark.parametrize("twice", [1, 2])
def test_charforms(make, twice):
    pairs = SAME + OTHER
    p = make("pdf_tokens", [{"token_id": i, "doc_id": 1, "text": a} for i, (a, _) in enumerate(pairs)] * twice).selectExpr("*", "1 AS rec_id", "'q' AS b")
    x = make("xhtml_tokens", [{"token_id": 100 + i, "pdf_token_id": i, "text": b} for i, (_, b) in enumerate(pairs)] + [{"token_id": 999, "pdf_token_id": None, "text": "z"}])
    d = make("differences", [{"diff_id": 1, "pdf_unicode": "U+FF4F U+0066", "xhtml_unicode": "U+006F, U+0066"}, {"diff_id": 2, "pdf_unicode": "U+0041", "xhtml_unicode": "U+0061"}, {"diff_id": 3, "pdf_unicode": "U+0041", "xhtml_unicode": ""}, {"diff_id": 4, "pdf_unicode": None, "xhtml_unicode": "U+0041"}])
    assert rows(charforms.found(p, x, d)) == {("token", i) for i in range(len(SAME))} | {("difference", 1)}
    assert rows(charforms.found(make("pdf_tokens"), make("xhtml_tokens"), make("differences"))) == set()


def test_form_is_stable_and_takes_long_text(make):
    df = make("pdf_tokens", [{"token_id": 1, "text": "ｔｅｘｔ​ " * 100_000}, {"token_id": 2, "text": None}, {"token_id": 3, "text": ""}])
    got = {r.token_id: r.form for r in charforms.consistent(df, "token_id").collect()}
    assert got[1] == " ".join(["text"] * 100_000) and got[2] is None and got[3] == ""


# ---- 2

TEXTS = {
    "en": "The old printer keeps the letters of the town in a wooden box near the window. When the rain stops, they will carry the books to the river house. Nobody knows who wrote these pages, but the reader found them worth the trouble.",
    "de": "Der alte Drucker bewahrt die Briefe der Stadt in einer hölzernen Kiste neben dem Fenster auf. Wenn der Regen aufhört, werden sie die Bücher in das Haus am Fluss tragen. Niemand weiß, wer diese Seiten geschrieben hat.",
    "fr": "Le vieil imprimeur garde les lettres de la ville dans une boîte en bois près de la fenêtre. Quand la pluie cessera, ils porteront les livres dans la maison au bord de la rivière. Personne ne sait qui a écrit ces pages.",
    "ru": "Старый печатник хранит письма города в деревянном ящике у окна. Когда дождь закончится, они отнесут книги в дом у реки. Никто не знает, кто написал эти страницы.",
    "uk": "Старий друкар зберігає листи міста в дерев’яній скрині біля вікна. Коли дощ закінчиться, вони віднесуть книжки до будинку біля річки. Ніхто не знає, хто написав ці сторінки.",
}
CODES = [{"lang_code": k, "spelling": s, "script": c} for k, c in (("en", "Latin"), ("de", "Latin"), ("fr", "Latin"), ("ru", "Cyrillic"), ("uk", "Cyrillic"), ("el", "Greek"), ("zh", "Han"), ("ja", "Japanese")) for s in (k, k.upper())]


def test_languages(make):
    docs = [{"doc_id": i, "text": TEXTS[k], "lang": k} for i, k in enumerate([*TEXTS] * 3)]
    docs += [
        {"doc_id": 100, "text": TEXTS["de"], "lang": "en"},
        {"doc_id": 101, "text": TEXTS["fr"], "lang": None},
        {"doc_id": 102, "text": TEXTS["en"] + "\n" + TEXTS["ru"], "lang": "en"},
        {"doc_id": 103, "text": TEXTS["en"].split(". ")[0] + ". " + TEXTS["fr"], "lang": "fr"},
        {"doc_id": 104, "text": "Kurz", "lang": None},
        {"doc_id": 105, "text": None, "lang": "de"},
        {"doc_id": 106, "text": "Το παλιό ευρετήριο εξηγεί την προέλευση του χαρτιού.", "lang": "??"},
        {"doc_id": 107, "text": "古い写本は異なる番号を見せている。出版社は多くの誤りを含んでいる。", "lang": "zh"},
        {"doc_id": 108, "text": TEXTS["uk"], "lang": "RU"},
    ]
    zones = make("zones", [{"zone_id": "z1", "tag": "p", "text": TEXTS["de"], "attributes": {"lang": "fr"}, "saved_at": T0}, {"zone_id": "z2", "tag": "ref", "text": TEXTS["de"], "saved_at": T0}, {"zone_id": "z3", "tag": "p", "text": TEXTS["de"], "attributes": None, "saved_at": T0}, {"zone_id": "z4", "tag": "p", "text": None}])
    d = make("documents", docs).selectExpr("*", "1 AS rec_id", "'x' AS labelled", "'y' AS spelling")
    got = rows(langid.found(d, zones, make("language_codes", CODES)))
    want = {("document", "100", "de"), ("document", "101", "fr"), ("document", "102", "en"), ("document", "102", "ru"), ("document", "103", "en"), ("document", "103", "fr"), ("document", "106", "el"), ("document", "107", "ja"), ("document", "108", "uk"), ("zone", "z1", "de"), ("zone", "z3", "de")}
    assert got == want


def test_second_languages_are_no_site_lines(make):
    fr = TEXTS["fr"].split(". ")
    docs = [{"doc_id": i, "text": f"{TEXTS[k]}\n{i}", "lang": k, "source": "b"} for i, k in enumerate([*TEXTS] * 12)]
    docs += [{"doc_id": 100 + i, "text": TEXTS["en"] + "\n" + TEXTS["fr"], "lang": "en", "source": "s"} for i in range(12)]
    docs += [{"doc_id": 200 + i, "text": f"{TEXTS['en']} {i}\n{fr[i % 3].upper()} {'ABCDEF'[i] * 3}", "lang": "en", "source": "s"} for i in range(6)]
    docs += [{"doc_id": 300 + i, "text": f"{TEXTS['en']} Copy {i}\n{TEXTS['de']}", "lang": "en", "source": "t"} for i in range(5)]
    docs += [{"doc_id": 400 + i, "text": f"{TEXTS['ru']} {i}\n" + "a" * 58, "lang": "ru", "source": "u"} for i in range(2)]
    got = rows(langid.found(make("documents", docs), make("zones"), make("language_codes", CODES)))
    assert got == {("document", str(i), k) for i in [*range(100, 112), *range(200, 206)] for k in ("en", "fr")}


def test_segments_of_mixed_texts(make):
    docs = make("documents", [{"doc_id": i, "text": TEXTS[k], "lang": k} for i, k in enumerate([*TEXTS] * 3)])
    codes = make("language_codes", CODES)
    zh, ja = "旧抄本在第二卷中说明了纸张的来历，编者没有提到别的证人，印刷所也保存着城里的信件和许多旧书。", "古い写本は異なる番号を見せている。出版社は多くの誤りを含んでいる、しかし資料の目録はほかの証人を挙げていない。"
    mixed = {
        "a": TEXTS["en"] + "\n" + TEXTS["ru"], "b": TEXTS["fr"] + "\n" + TEXTS["de"] + "\n" + TEXTS["fr"], "c": zh + "\n" + ja, "d": TEXTS["en"], "e": "12 34", "f": "", "g": None,
    }
    df = make("zones", [{"zone_id": k, "text": t} for k, t in mixed.items()] * 2).selectExpr("'zone' AS rec_kind", "zone_id AS rec_id", "text").distinct()
    got: dict = {}
    for r in langid.segments(df, langid.fit(docs, codes)).orderBy("rec_id", "start").collect():
        assert 0 < r.confidence <= 1
        got.setdefault(r.rec_id, []).append((r.lang, mixed[r.rec_id][r.start : r.stop]))
    assert {k: [x for x, _ in v] for k, v in got.items()} == {"a": ["en", "ru"], "b": ["fr", "de", "fr"], "c": ["zh", "ja"], "d": ["en"]}
    assert all("".join(t for _, t in v) == mixed[k] for k, v in got.items())
    assert got["a"][1][1].strip() == TEXTS["ru"] and got["c"][1][1].strip() == ja


def test_languages_of_nothing(make):
    assert rows(langid.found(make("documents"), make("zones"), make("language_codes", CODES))) == set()
    long = make("documents", [{"doc_id": 1, "text": TEXTS["en"] * 2000, "lang": None}, *({"doc_id": 2 + i, "text": t, "lang": k} for i, (k, t) in enumerate([*TEXTS.items()] * 3))])
    assert ("document", "1", "en") in rows(langid.found(long, make("zones"), make("language_codes", CODES)))


def test_garbled_texts_have_a_language(make):
    docs = [{"doc_id": i, "text": t, "lang": k} for i, (k, t) in enumerate([*TEXTS.items()] * 3)]
    docs += [{"doc_id": 200, "text": TEXTS["ru"].encode().decode("cp1252", "replace"), "lang": "en"}, {"doc_id": 201, "text": TEXTS["uk"].encode("cp1251").decode("latin-1"), "lang": None}, {"doc_id": 202, "text": "\x93\x81"*30, "lang": None}, {"doc_id": 203, "text": "Ã" * 40, "lang": None}]
    assert rows(langid.found(make("documents", docs), make("zones"), make("language_codes", CODES))) == {("document", "200", "ru"), ("document", "201", "uk")}
    assert langid.readable("naïve café") is None and langid.readable("") is None


def test_distances_are_out_of_place_means_with_small_tables():
    import random
    from collections import Counter

    import numpy as np

    rnd = random.Random(3)
    letters = langid.tables()[1]
    texts = ["".join(rnd.choice("abcdefghij klmnop ßéñ") for _ in range(n)) for n in (0, 1, 2, 40, 400, 6000)] + ["да нет " * 9]
    codes = [letters[np.frombuffer((t + "\x01").encode("utf-32-le"), np.uint32)] for t in texts]
    grams = [[int(g) for x in langid.ngram_codes(c) for g in x if g >= 0] for c in codes]
    order = [sorted(set(g), key=lambda x, n=Counter(g): (-n[x], x))[: langid.PROFILE] for g in (grams[5], grams[4] + grams[6])]
    p = langid.Profiles(["a", "b"], ["Latin", "Latin"], [np.array(o, np.int64) for o in order], {}).prepare()
    every = sorted(set(order[0] + order[1]))
    got = p.distances(np.concatenate(codes), np.repeat(np.arange(len(texts)), [len(c) for c in codes]), len(texts))
    for g, row in zip(grams, got):
        n = Counter(x for x in g if x in set(every))
        top = sorted(n, key=lambda x: (-n[x], x))[: langid.TOP]
        want = [sum(abs(r - o.index(x)) if x in o else langid.PROFILE for r, x in enumerate(top)) / len(top) if top else langid.PROFILE for o in order]
        assert row.tolist() == pytest.approx(want)
    assert sum(t.nbytes for t in p.index) < 1 << 21


def test_only_texts_with_runs_of_a_letter_are_looked_at():
    texts = ["aaaaaaa", "an aaaaaaaa!", "........ 11111111", "", "ж" * 9, "aaaa", "aaaa"]
    assert langid._with_runs(texts) == [r for r, t in enumerate(texts) if langid._RUN.search(t)] == [1, 4]
    assert langid._with_runs([]) == []


def test_token_counts_alone_leave_the_workers(make):
    docs = make("documents", [{"doc_id": i, "text": t} for i, t in enumerate([None, "", "one two", "Ünïcode 漢字 <|endoftext|>"])])
    got = encode.token_counts(docs)
    assert rows(got) == {(r.doc_id, len(r.ids)) for r in encode.encode(docs).collect()}
    assert "ids" not in got._jdf.queryExecution().optimizedPlan().toString()


# ---- 3

def line(i, text, **kw):
    return {"line_id": i, "doc_id": 1, "page": 1, "block_no": 2, "line_no": i, "text": text, "font_size": 9.0, "bold": False, "source": "OCR", **kw}


def test_scan_defects(make):
    body = [line(10 + i, t) for i, t in enumerate(["The garden of the printer is well-known and the govern-", "ment of the town keeps the gardcn in the well-", "known house near the r1ver where the old lamp stood"])]
    more = [line(100 + i, "the garden near the river in the garden of the government and the well-known garden", page=2, line_no=i) for i in range(30)]
    lines = make("line_features", [line(1, "GARDENER", block_no=1), *body, line(30, "- 12 -", block_no=3), *more, line(200, None), line(201, ""), line(10, body[0]["text"])])
    zones = make("zones", [{"zone_id": "z", "doc_id": 1, "tag": "p", "text": "a garden of the govern-\n- 14 -\nment near the gardcn", "saved_at": T0}, {"zone_id": "n", "tag": "p", "text": None}])
    got = rows(scanfix.defects(lines, zones))
    assert got == {("line", "1", "furniture"), ("line", "30", "furniture"), ("line", "10", "hyphen"), ("line", "11", "misread"), ("line", "12", "misread"), ("zone", "z", "furniture"), ("zone", "z", "hyphen"), ("zone", "z", "misread")}
    text = " ".join(r.text for r in scanfix.repaired_lines(lines, zones).collect())
    assert "government of the town keeps the garden in the well-known house" in text and "GARDENER" not in text
    assert rows(scanfix.defects(make("line_features"), make("zones"))) == set()


def test_paragraphs_of_lines_and_zones_are_repaired(make):
    body = ["Gardcn near the g0ver-", "nment stood in the gov-", "ern-", "ment house by the well-", "known lamp"]
    more = [line(100 + i, "the garden near the river in the garden of the government and the well-known garden", page=2, line_no=i) for i in range(30)]
    notice = line(50, "Printed for subscribers", block_no=3, font_size=6.0)
    lines = make("line_features", [*(line(10 + i, t) for i, t in enumerate(body)), notice, *more])
    texts = {"z": "THE GARDCN of the g0vern-\n- 14 -\nment, a well- known gardcn", "e": "", "n": None, "t": "A title"}
    zones = make("zones", [{"zone_id": k, "doc_id": 1, "tag": "title" if k == "t" else "p", "text": t, "saved_at": T0} for k, t in texts.items()])
    got = scanfix.repaired_lines(lines, zones).collect()
    first = next(r for r in got if r.zone_id is None and r.paragraph == 1)
    assert first.kind == "text" and first.text.startswith("Garden near the government stood in the government house by the well-known lamp the garden near")
    assert [(r.kind, r.text) for r in got if r.zone_id is None and r.paragraph > 1] == [("notice", "Printed for subscribers")]
    assert {(r.zone_id, r.doc_id, r.text) for r in got if r.zone_id} == {("z", 1, "THE GARDEN of the government, a well-known garden")}
    assert scanfix.repaired_lines(make("line_features"), make("zones")).collect() == []


# ---- 5

def wrong(text, wrong_enc="cp1252"):
    return text.encode().decode(wrong_enc, "replace")


def test_wrong_decoding(make):
    plain = ["Die Fußnote erklärt die frühere Fassung für spätere Leser", "Le modèle précédent mène à la première édition déjà citée", "20 °C and 5 µm, © 1902 — “so” it’s …", "naïve façade"] * 50
    bad = [wrong("Die Fußnote erklärt"), wrong(wrong("première édition")), "V�ase", "die fr\xc3\xbchere", "modèle".encode("cp1252").decode("cp437"), "a\x93quoted\x94b"]
    zones = make("zones", [{"zone_id": f"ok{i}", "tag": "p", "text": t, "saved_at": T0} for i, t in enumerate(plain)] + [{"zone_id": f"bad{i}", "tag": "p", "text": t, "saved_at": T0} for i, t in enumerate(bad)] + [{"zone_id": "n", "text": None}, {"zone_id": "e", "text": ""}])
    got = {r.rec_id: r.restored for r in mojibake.repaired(make("pdf_tokens", [{"token_id": 5, "text": wrong("über")}, {"token_id": 6, "text": "über"}] * 2), zones).collect()}
    assert set(got) == {"5", *(f"bad{i}" for i in range(len(bad)))}
    assert got["5"] == "über" and got["bad0"] == "Die Fußnote erklärt" and got["bad1"] == "première édition" and got["bad4"] == "modèle"
    info = mojibake.table_of(mojibake.corpus(make("pdf_tokens"), zones))
    long = mojibake.restored(make("zones", [{"zone_id": "l", "text": plain[0] * 5000 + wrong("für")}]), info, "zone_id").first()
    assert long.wrong and long.restored == plain[0] * 5000 + "für"
    assert rows(mojibake.found(make("pdf_tokens"), make("zones"))) == set()


# ---- 6

ENDS = [
    ("See Dr. Fenn, vol. 9, p. 17. It is 5 p.m. in York. Who has it?", ["p. 17.", "York.", "it?"]),
    ("“Is it late?” asked the boy. “No!” Nemova shouted. We lack maps, etc. The end", ["boy.", "shouted.", "etc.", "end"]),
    ("Am 10. März 1786 schrieb er d. h. spät. „Ist es fertig?“, fragte sie.", ["spät.", "sie."]),
    ("В 1733 г. М. А. Малдеев отправил т. е. больше. «Готово?» — спросил он.", ["больше.", "он."]),
    ("完了。「もう終わりましたか。」と聞いた。「はい。」次へ", ["完了。", "聞いた。", "「はい。」", "次へ"]),
    ("“校样好了吗？”编辑问。缺少地图等……第二版", ["编辑问。", "等……", "第二版"]),
    ("دفتر أول. من عد اللوحات؟ «هل انتهى؟» سأل الناشر.", ["أول.", "اللوحات؟", "الناشر."]),
    ("डॉ. वरदेव ने पृ. 9 पर लिखा। क्या है? हाँ", ["लिखा।", "है?", "हाँ"]),
    ("ต้นฉบับเก่า ใครนับภาพ", ["เก่า", "ภาพ"]),
    ("Είναι έτοιμο; Ναι. Βλ. τόμ. 9.", ["έτοιμο;", "Ναι.", "9."]),
    ("It weighs 4.39 kg (see Fig. 8.8). The file www.x.example/v1.2 moved.Next one… or so it goes on.", ["8.8).", "moved.", "on."]),
    ("(The table is larger.) From here", ["larger.)", "here"]),
    ("", []),
    (" \n ", []),
    ("...", []),
]


@pytest.mark.parametrize("text,want", ENDS)
def test_sentence_ends(text, want):
    got, last = [], 0
    for e in sentences.ends(text):
        got.append(text[last:e].strip())
        last = e
    assert len(got) == len(want) and all(g.endswith(w) for g, w in zip(got, want)), got


CLOSED = [
    ("“河流一章显示不同的页码！”最初的索引没有提到别的证人。", ["页码！”", "证人。"]),
    ("全书很重。“校样好了吗？”编辑在门\n口问。“好了。”他说。他读小说。", ["很重。", "口问。", "他说。", "小说。"]),
    ("“快看！”1792年出了第二版。“好！”的喊声停了。", ["快看！”", "第二版。", "停了。"]),
    ("「終わりましたか？」編集者は尋ねた。「はい！」とても古い本だ。「え？」彼女は本を聞いた。", ["尋ねた。", "はい！」", "本だ。", "え？」", "聞いた。"]),
    ("“다 되었습니까?” 하고 편집자가 물었다. “유래를 밝힌다!” 이 책은 약 32.84kg이다. “네.” 그가 말했다.", ["물었다.", "밝힌다!”", "32.84kg이다.", "말했다."]),
    ("“क्या यह तैयार है?” प्रकाशक ने दरवाज़े पर पूछा। रचना “बताता है!” पुरानी पांडुलिपि लाल है।", ["पूछा।", "है!”", "लाल है।"]),
    ("«هل انتهى؟» سأل الناشر عند الباب. «نعم!» الكتاب قديم.", ["الباب.", "نعم!»", "قديم."]),
    ("«נגמר?» שאל העורך. «כן!» הספר ישן.", ["העורך.", "כן!»", "ישן."]),
    ("“เสร็จไหม?”เขาถาม", ["ถาม"]),
    ("“เสร็จแล้ว!” ต้นฉบับเก่า", ["แล้ว!”", "เก่า"]),
    ("他走了（真的吗？）又回来。（谁数过？）第二版。", ["回来。", "谁数过？）", "第二版。"]),
]


@pytest.mark.parametrize("text,want", CLOSED)
def test_closed_quotes_before_caseless_letters(text, want):
    test_sentence_ends(text, want)


def test_sentences_of_tables(make):
    zones = make("zones", [{"zone_id": "a", "tag": "p", "text": "One here. Two\nthere.\n- 12 -\nAnd three", "saved_at": T0}, {"zone_id": "a", "tag": "p", "text": "stale.", "saved_at": None}, {"zone_id": "t", "tag": "title", "text": "No. Yes.", "saved_at": T0}, {"zone_id": "n", "tag": "p", "text": None}, {"zone_id": "w", "tag": "p", "text": "V�ase.", "saved_at": T0}])
    lines = make("line_features", [line(1, "A heading", font_size=14.0, bold=True, block_no=1), line(2, "Body text that goes on"), line(3, "to here. And it"), line(4, "Printed for subscribers only", font_size=7.5, block_no=3), line(5, "ends.", block_no=4), line(5, "ends.", block_no=4), line(6, None, block_no=5)])
    got = rows(sentences.sentence_ends(zones, lines, make("pdf_tokens")))
    assert got == {("zone", "a", 9), ("zone", "a", 20), ("zone", "a", 37), ("line", "1", 9), ("line", "3", 8), ("line", "5", 5)}
    assert rows(sentences.sentence_ends(make("zones"), make("line_features"), make("pdf_tokens"))) == set()
    long = make("zones", [{"zone_id": "l", "tag": "p", "text": "It ends here. " * 20_000, "saved_at": T0}])
    assert sentences.sentence_ends(long, make("line_features")).count() == 20_000


# ---- 7

def test_site_lines(make):
    from collections import defaultdict

    docs = make("documents", [{"doc_id": i, "source": "big" if i < 30 else "small" if i < 33 else None, "text": f"Own text {i} with words\nShare this chapter with a friend {i}"} for i in range(36)])
    lines, texts = [], {}
    for i in range(36):
        for k, t in enumerate([f"Own text number {'abcdefghij'[i % 10] * (i + 1)}", f"Share this chapter with a friend {i}", "too short", "Seldom repeated line here" if i in (0, 1, 2, 30) else None]):
            lines.append({"line_id": 10 * i + k, "doc_id": i, "text": t, "loaded_at": datetime(2024, 1, 1 + i % 28)})
            texts[10 * i + k] = (i, t)
    want, seen = set(), defaultdict(set)
    source = lambda i: "big" if i < 30 else "small" if i < 33 else None
    key = lambda t: "".join(c for c in (t or "").lower() if c.isalpha())
    for i, t in texts.values():
        seen[source(i), key(t)].add(i)
    for n, (i, t) in texts.items():
        s, k = source(i), key(t)
        if s and len(k) >= 15 and len(seen[s, k]) >= 3 and len(seen[s, k]) >= 0.1 * (30 if s == "big" else 3):
            want.add((n,))
    df = make("line_features", lines + lines[:5]).selectExpr("*", "'k' AS key", "'s' AS n_docs")
    assert rows(sitelines.repeated_lines(df, docs)) == want and want
    clean = {r.doc_id: (r.text, r.n_removed) for r in sitelines.cleaned_documents(docs, df).collect()}
    assert clean[0] == ("Own text 0 with words", 1) and clean[35][1] == 0
    assert rows(sitelines.repeated_lines(make("line_features"), make("documents"))) == set()


def test_line_store_by_deltas(spark, make):
    docs = make("documents", [{"doc_id": i, "source": "s"} for i in range(6)])
    store = sitelines.LineStore(spark)
    text = lambda ids: make("line_features", [{"line_id": i, "doc_id": i, "text": "Share this chapter with friends"} for i in ids])
    store.merge(sitelines.keyed(text([0, 1]), docs).drop("line_id"))
    assert store.crossed().count() == 0 and store.to_rebuild().count() == 0
    store.merge(sitelines.keyed(text([1, 2]), docs).drop("line_id"))
    assert store.crossed().count() == 1 and rows(store.to_rebuild()) == {(0,), (1,), (2,)}
    store.merge(sitelines.keyed(text([3]), docs).drop("line_id"))
    assert store.to_rebuild().count() == 0 and store.sizes().first().n_source == 4


# ---- 8

def test_only_named_documents_are_rebuilt(spark, make):
    """A late load pushes a line over the threshold: its documents are renewed, the rest of the state stays."""
    docs = make("documents", [{"doc_id": i, "source": "s", "text": f"own {i}\nShare this page with all friends\nPrinted by the house of books"} for i in range(40)])
    rows = [line(i, "Printed by the house of books", doc_id=i) for i in range(30)] + [line(100 + i, "Share this page with all friends", doc_id=i, loaded_at=datetime(2024, 6, 1)) for i in range(3)]
    rows += [line(200 + i, "Share this page with all friends", doc_id=30 + i, loaded_at=datetime(2024, 6, 1)) for i in range(3)]
    lines = make("line_features", rows)
    got = {r.doc_id: (r.text, r.n_removed) for r in sitelines.cleaned_documents(docs, lines).collect()}
    assert got == {i: (f"own {i}", 2) for i in range(40)}
    store = sitelines.LineStore(spark)
    store.index(docs)
    for part in (lines.where("line_id < 100"), lines.where("line_id >= 100")):
        store.merge(sitelines.keyed(part, docs).drop("line_id"))
    assert store.texts_to_rebuild().count() == 40 and store.changed().count() == 1


def test_encoding(make):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encode.read_ranks(encode.vocabulary_path()), special_tokens={})
    texts = ["The naïve façade — 12,5 kg!", "カタログのデータ", "  two  spaces\n\n\tend ", "<|endoftext|> it's we'll", "ต้นฉบับเก่า", "😀👩‍👩‍👧", "a" * 3000, "word " * 50_000, "", None, "x\x00y�"]
    df = make("documents", [{"doc_id": i, "text": t} for i, t in enumerate(texts)] + [{"doc_id": 0, "text": texts[0]}]).selectExpr("*", "1 AS ids")
    got = encode.encode(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert list(r.ids) == (enc.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else [])
    assert encode.encode(make("documents")).count() == 0


def test_encoding_of_any_text():
    import public_tokenizers
    import tiktoken
    from hypothesis import given, settings
    from hypothesis import strategies as st

    path = encode.vocabulary_path()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encode.read_ranks(path), special_tokens={})
    own = encode.Encoder.of(path, encode.pair_tables(path))

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
    def check(text):
        assert [i for w in own.texts([text])[0] for i in w] == enc.encode_ordinary(text)
        assert enc.decode([i for w in own.texts([text])[0] for i in w]) == text

    check()


# ---- 9

def test_raking():
    cells = [("a", "en", "x", 1000.0), ("a", "de", "y", 500.0), ("b", "en", "x", 100.0), ("b", "de", "x", 50.0), ("c", "en", "y", 400.0)]
    shares, most = {"a": 0.5, "b": 0.4, "c": 0.1, "none": 0.0}, {"a": 1, "b": 3, "c": 2, "none": 1}
    w = mixing.rake(cells, shares, most, 1200.0)
    got = {}
    for (s, _, _, n), x in zip(cells, w):
        assert 0 <= x <= most[s] + 1e-9
        got[s] = got.get(s, 0) + n * x
    assert abs(got["a"] - 600) < 1 and abs(got["c"] - 120) < 1 and abs(got["b"] - 450) < 1  # b can't reach 480


def test_mixing(make):
    docs = make("documents", [{"doc_id": i, "source": ["big", "small", "other", None][0 if i < 300 else 1 if i < 330 else 2 if i < 340 else 3], "lang": "en" if i % 3 else "de", "doc_kind": "notes" if i % 2 else None, "text": None if i % 50 == 0 else "some words of text " * (1 + i % 7)} for i in range(345)]).selectExpr("*", "1 AS w", "'k' AS kind", "0 AS uses")
    targets = make("mix_targets", [{"source": "big", "target_share": 0.6, "max_repeats": 1}, {"source": "small", "target_share": 0.3, "max_repeats": 5}, {"source": "empty", "target_share": 0.1, "max_repeats": 2}] * 2)
    uses = {r.doc_id: r for r in mixing.mix(docs, targets, make("language_codes", CODES)).collect()}
    assert set(uses) == set(range(330)) and all(0 <= r.uses <= (1 if r.source == "big" else 5) for r in uses.values())
    s = {r.source: r for r in mixing.shares(docs, targets, make("language_codes", CODES)).collect()}
    assert s["empty"].tokens == 0 and abs(sum(r.reached_share for r in s.values()) - 1) < 1e-9
    assert abs(s["big"].reached_share - 2 / 3) < 0.03 and abs(s["small"].reached_share - 1 / 3) < 0.03
    assert mixing.shares(make("documents"), targets, make("language_codes", CODES)).count() == 3


# ---- 10

def test_sources_hold_their_tokens(make):
    """Each reachable source is off its target by less than one document's tokens."""
    docs = [{"doc_id": i, "text": "word " * (10 + 37 * i % 400), "source": "abc"[i % 3] if i % 5 else "a", "lang": "en", "doc_kind": f"k{i % 4}"} for i in range(900)]
    targets = [{"source": s, "target_share": w, "max_repeats": 3} for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))]
    m = mixing.mix(make("documents", docs), make("mix_targets", targets), make("language_codes", CODES)).collect()
    total = sum(r.n_tokens for r in m)
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(sum(r.n_tokens * r.uses for r in m if r.source == s) - w * total) <= max(r.n_tokens for r in m if r.source == s)
    assert max(r.uses for r in m) <= 3 and len(m) == 900


def test_reading_levels(make):
    import random

    r = random.Random(3)
    easy, hard = "cat dog sun boy map red big box".split(), "historiographical epistemological juxtaposition conceptualisation heterogeneous commensurate stratigraphic interpretation".split()
    rows_, labels_ = [], []
    for i in range(120):
        g = 1 + i % 5
        n = 4 + 4 * g
        text = " ".join("The " + " ".join(r.choice(hard) if r.random() < (g - 1) / 4 else r.choice(easy) for _ in range(n)) + "." for _ in range(12))
        rows_.append({"doc_id": i, "text": text, "lang": "en", "n_chars": len(text)})
        if i < 80:
            labels_.append({"doc_id": i, "rater": "a", "grade": g, "labelled_at": T0})
    rows_ += [{"doc_id": 500, "text": TEXTS["de"] * 3, "lang": "de", "n_chars": 700}, {"doc_id": 501, "text": None}, {"doc_id": 502, "text": "", "n_chars": 0}, {"doc_id": 503, "text": rows_[4]["text"] + " " + TEXTS["de"], "lang": "en", "n_chars": 3000}]
    docs, labels = make("documents", rows_).selectExpr("*", "1 AS score", "2 AS letters"), make("reading_labels", labels_ * 2 + [{"doc_id": 90, "grade": None}])
    got = {x.doc_id: x.level for x in reading.levels(docs, labels, make("language_codes", CODES)).collect()}
    assert sum(got[i] == 1 + i % 5 for i in range(80, 120)) >= 34
    assert got[500] is None and got[501] is None and got[502] is None and got[503] is None
    found = {x.doc_id for x in reading.found(docs, labels, make("language_codes", CODES)).collect()}
    assert all((1 + i % 5 >= 4) == (i in found) for i in range(80, 120) if i % 5 not in (2, 3))
    none = {x.level for x in reading.levels(docs, make("reading_labels"), make("language_codes", CODES)).collect()}
    assert none == {None} and reading.levels(make("documents"), labels, make("language_codes", CODES)).count() == 0


def test_word_lattices_and_dots(make):
    """Words counted from a corpus cover their runs; gaps are judged by the words beside them; points by what follows them."""
    first, last = ["ดัชนีแรก", "ผู้แปล", "โรงพิมพ์"], ["เพื่อผู้อ่าน", "ในเล่มที่สอง", "หลายแห่ง"]
    text = [f"{a}มีข้อผิดพลาด{b} {c}แสดงหน้า{d}" for a in first for b in last for c in first for d in last]
    df = make("zones", [{"zone_id": str(i), "text": t} for i, t in enumerate([*text, None, "", "of the bks. they saw", "in the bks. and maps"])])
    words = sentences.learn_words(df.selectExpr("text", "true AS whole"))
    assert words.weights and all("".join(words.path(r)) == r for r in (*first, *last, "กข", "中文"))
    assert words.gap_ends(text[0][:20] + "ในเล่มที่สอง", "ผู้แปลแสดง") and not words.gap_ends("ดัชนีแรกมีข้อ", "ผิดพลาดหลายแห่ง")
    dots = sentences.learn_dots(df)
    assert dots == {"bks": (2, 0)}
    assert sentences.ends("See the bks. They are here. Go.", None, dots) == [27, 31] and sentences.ends("See the bks. They are here. Go.") == [12, 27, 31]
    none = sentences.learn_words(df.limit(0).selectExpr("text", "true AS whole"))
    assert not none.weights and sentences.ends("กขค\nงจฉ", none, {}) == [7]
