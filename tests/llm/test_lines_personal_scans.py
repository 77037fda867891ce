from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from actaloom.llm import personal, scans, site_lines
from actaloom.operators import texts


def test_repeated_lines_against_brute_force(spark):
    rnd = random.Random(3)
    rows, cat = [], []
    for i in range(120):
        site = "hot" if i < 80 else "b" if i < 115 else ""
        lines = [f"linha própria {i} {''.join(rnd.choices('abcdefghijklmnop', k=12))}" for _ in range(4)]
        if i % 2:
            lines.insert(rnd.randint(0, 4), rnd.choice(["Aviso legal do sítio", "  AVISO LEGAL, do sítio! ", f"Aviso legal {i} do sítio"]))
        if i % 9 == 0:
            lines.append("Raro mas repetido")
        rows.append((f"p{i}", "\n".join(lines)))
        cat.append((f"p{i}", site, "x"))
    rows += [rows[1], ("n", None), ("blank", " \n ")]
    cat += [cat[0], ("n", "b", "x"), ("blank", "b", "x"), (None, "b", "x"), ("p3", None, "x"), ("gone", "hot", "x")]
    pages, catalog = spark.createDataFrame(rows, "rel_raw string, text string"), spark.createDataFrame(cat, "rel_raw string, website string, line_no string")
    got = {(r["rel_raw"], r["line_no"]) for r in site_lines.repeated_lines(catalog, "website", "rel_raw", pages, "rel_raw", "text").collect()}
    text, want = dict(rows), set()
    for site in ("hot", "b"):
        own = sorted({p for p, s, _ in cat if s == site and text.get(p) and text[p].strip()})
        where: dict = {}
        for p in own:
            for n, x in enumerate(text[p].split("\n"), 1):
                if k := "".join(c for c in x if c.isalpha()).lower():
                    where.setdefault(k, []).append((p, n))
        for hits in where.values():
            if len({p for p, _ in hits}) >= max(10, 0.08 * len(own)):
                want |= set(hits)
    assert got == want and want
    clean = {r["rel_raw"]: r["text"] for r in site_lines.without_lines(pages, "rel_raw", "text", spark.createDataFrame(sorted(got), "rel_raw string, line_no bigint")).collect()}
    assert "aviso" not in clean["p1"].lower() and clean["p2"] == text["p2"] and clean["n"] is None
    assert site_lines.repeated_lines(catalog.limit(0), "website", "rel_raw", pages, "rel_raw", "text").count() == 0
    assert site_lines.repeated_lines(catalog, "website", "rel_raw", pages.limit(0), "rel_raw", "text").count() == 0


def test_templates_with_wildcards(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        name = "".join(rnd.choices("abcdefghij", k=4))
        rows.append((f"p{i}", f"Aviso\nPubl icad oema rqui vist {name} voda cama radi anal dodi stri tofi\n{''.join(rnd.choices('abcdefghijklm', k=30))}"))
    pages = spark.createDataFrame(rows, "rel_raw string, text string")
    catalog = pages.select("rel_raw", F.lit("s").alias("website"))
    got = {r["template"]: (r["pages"], r["forms"]) for r in site_lines.site_templates(catalog, "website", "rel_raw", pages, "rel_raw", "text").collect()}
    assert got == {"aviso": (60, 1), "publicadoemarquivist*vodacamaradianaldodistritofi": (60, 60)}
    lines = {r["line_no"] for r in site_lines.repeated_lines(catalog, "website", "rel_raw", pages, "rel_raw", "text").collect()}
    assert lines == {1}  # no form of the second line is frequent itself


def test_pages_of_two_texts_give_the_same_result_in_any_order(spark):
    rows = [(f"p{i}", f"Aviso legal\nlinha {chr(97 + i)}") for i in range(15)] + [("p3", "Zona\nAviso legal"), ("p3", "Aviso legal\nlinha d")]
    pages, got = spark.createDataFrame(rows, "rel_raw string, text string"), []
    catalog = pages.select("rel_raw", F.lit("s").alias("website"))
    for df in (pages, spark.createDataFrame(rows[::-1], "rel_raw string, text string")):
        got.append({(r["rel_raw"], r["line_no"]) for r in site_lines.repeated_lines(catalog, "website", "rel_raw", df, "rel_raw", "text").collect()})
    assert got[0] == got[1] and ("p3", 1) in got[0] and ("p3", 2) not in got[0]


GIVEN = "Olegário Quitéria Jacinta Rosalinda Albertina Valdemar".split()
FAMILY = "Pinhalvo Farrobo Dorvalho Queirosa Corvinhal Cardelho".split()


def test_personal_information(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        name, other = (f"{rnd.choice(GIVEN)} {rnd.choice(FAMILY)}" for _ in range(2))
        prefix = "+351 " if i % 3 == 0 else ""
        rows.append((f"p{i}", f"Compareceu o Sr. {name} em representação da Corvinhal & Farrobo, Lda.\nA testemunha {other} confirmou a avaria em Ponte Nova.\nTlm. +351 91{i:07d} | e-mail: a{i}@caixa.test\nO contacto deixado foi {prefix}93{i:07d} ou, em alternativa, outro.\nA fatura n.º 21{i:07d} subiu. Processo n.º 12/2020."))
    rows += [
        ("x", "A testemunha Odília Pinhalvo confirmou a avaria. Contribuinte n.º 244 392 452, passaporte DA319665.\nDomicílio: Rua do Moinho Velho, n.º 12, 3.º Esq.\n4999-101 Almoral\nEscreveu para jose (at) orvalho.example hoje. Farrobo, Jacinta pagou. Santa Quitéria da Serra."),
        ("n", None), ("e", ""), ("x2", "z" * 50_000),
    ]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows + rows[:3]], "rel_raw string, text string, kind int")
    found = personal.personal_information(df, "rel_raw", "text")
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["rel_raw"], set()).add((r["kind"], r["found_text"]))
    assert got["x"] == {
        ("person", "Odília Pinhalvo"), ("person", "Farrobo, Jacinta"), ("id_number", "244 392 452"), ("id_number", "DA319665"),
        ("address", "Rua do Moinho Velho, n.º 12, 3.º Esq.\n4999-101 Almoral"), ("email", "jose (at) orvalho.example"),
    }
    assert {k for k, _ in got["p7"]} == {"person", "phone", "email"}
    assert ("phone", "930000007") in got["p7"] and not any("210000007" in v for _, v in got["p7"])
    places = personal.mentions(df, "rel_raw", "text")
    clean = {r["rel_raw"]: r["text"] for r in personal.redact(df, "rel_raw", "text", places).collect()}
    assert "[EMAIL]" in clean["p7"] and "@" not in clean["p7"] and "Corvinhal & Farrobo, Lda." in clean["p7"] and clean["n"] is None
    assert personal.personal_information(df.limit(0), "rel_raw", "text").count() == 0


def test_rounds_discover_what_one_round_does_not(spark, monkeypatch):
    first = [(f"a{i}", f"Depois ligue para o +351 91{i:07d} amanhã cedo.") for i in range(6)]  # seeds teach the first pattern
    bridge = [(f"b{i}", f"Depois ligue para o 96{i:07d} amanhã cedo.\nA vizinha anotou aquele 96{i:07d} num papel.") for i in range(6)]
    last = [("k", "A vizinha anotou aquele 934445556 num papel.")]
    df = spark.createDataFrame(first + bridge + last, "rel_raw string, text string")
    found = lambda: {(r["rel_raw"], r["found_text"]) for r in personal.personal_information(df, "rel_raw", "text").filter("kind = 'phone'").collect()}
    assert ("k", "934445556") in found()
    monkeypatch.setattr(personal, "ROUNDS", 1)
    assert ("k", "934445556") not in found() and ("b1", "960000001") in found()


def test_patterns_admit_loose_addresses(spark):
    mails = [(f"m{i}", f"Pode escrever para nome{i}@caixa.test até sexta.") for i in range(6)]
    homes = [(f"h{i}", f"Este autor, residente na Rua do Moinho {chr(65 + i)}breu, n.º {i + 1}, 4999-10{i} Almoral.") for i in range(6)]
    rows = mails + homes + [
        ("x", "Pode escrever para rita at orvalho . example até sexta."), ("y", "O jantar at home . Depois saiu."),
        ("z", "Este autor, residente na Quinta Velha 7, 4999-101 Almoral."), ("w", "O lote Quinta Nova 8, 4999-102 Almoral foi vendido."),
    ]
    df = spark.createDataFrame(rows, "rel_raw string, text string")
    got = {(r["rel_raw"], r["kind"], r["found_text"]) for r in personal.personal_information(df, "rel_raw", "text").filter("rel_raw in ('x', 'y', 'z', 'w') and kind in ('email', 'address')").collect()}
    assert got == {("x", "email", "rita at orvalho . example"), ("z", "address", "Quinta Velha 7, 4999-101 Almoral")}


def test_redaction_by_place(spark):
    text = "O Sr. Rui Farrobo falou pela Rui Farrobo, Lda. com o Sr. Rui Farrobo."
    pages = spark.createDataFrame([("a", text), ("a", text), ("b", text + " z"), ("b", text), ("n", None)], "rel_raw string, text string")
    second = text.rindex("Rui")
    found = spark.createDataFrame([(r, "person", "Rui Farrobo", s) for r in "ab" for s in (6, second)] + [("b", "person", "Rui", 6), ("b", "email", "gone", 3)], "rel string, kind string, text string, start int")
    got = {r["rel_raw"]: r["text"] for r in personal.redact(pages, "rel_raw", "text", found).collect()}
    assert got == {"a": "O Sr. [PERSON] falou pela Rui Farrobo, Lda. com o Sr. [PERSON].", "b": "O Sr. [PERSON] falou pela Rui Farrobo, Lda. com o Sr. [PERSON].", "n": None}


def test_one_text(spark):
    rows = [("a", "x"), ("a", "x"), ("b", "2"), ("b", "1"), ("c", None), ("c", "y"), ("d", None), (None, "z")]
    df = spark.createDataFrame(rows, "k string, t string")
    assert sorted((r["rel"], r["text"] or "") for r in texts.one_text(df, "k", "t").collect()) == [("a", "x"), ("a", "x"), ("b", "1"), ("c", "y"), ("d", "")]


def test_mail_signs(spark):
    signs = ["@", " arroba ", *(f"{sp}{o}{gap}{w}{gap}{c}{sp}" for o, c in ("()", "[]", "{}") for w in ("at", "arroba", "@") for gap in ("", " ") for sp in ("", " "))]
    dots = [".", *(f"{sp}{o}{w}{c}{sp}" for o, c in ("()", "[]") for w in ("dot", "ponto", ".") for sp in ("", " "))]
    mails = [f"nome.a-b{s}dominio.pt" for s in signs] + [f"nome@dominio{d}pt" for d in dots] + [f"nome{s}dominio (ponto) pt" for s in signs]
    pages = spark.createDataFrame([(f"{k:03d}", f"Escreveu, para {m} hoje.") for k, m in enumerate(mails)], "rel string, text string")
    got = {(r["rel"], r["text"]) for r in personal.candidates(pages, "rel", "text").filter("kind = 'email'").collect()}
    want = {(f"{k:03d}", m) for k, m in enumerate(mails)}
    assert got == want == {(k, personal.EMAIL.search(f"Escreveu, para {m} hoje.").group()) for k, m in want}


def test_scan_pieces():
    assert scans.fold("rernetido") == scans.fold("remetido") and scans.fold("pr@z0") == scans.fold("prazo")
    assert scans.edits("rernetido", "remetido") == 1 and scans.edits("dir", "eur") > 1
    lines = ["Tribunal", "corpo", "— 1 / 3 —", "Tribunal", "2018.", "- 2 -", "x", "— 2 / 3 —", "y", "— 3 / 3 —"]
    assert set(scans.marks(lines)) >= {2, 7, 9} and 4 not in scans.marks(lines)
    assert set(scans.marks(["a", "i", "b", "ii", "c", "1ii"])) == {1, 3, 5}
    assert scans.decode(["o", "prec0"], {"prec0": {"prec0": 1e-3, "preço": 50.0}}, {}, scans.Channel()) == ["o", "preço"]


def test_all_words_of_a_look_are_options(spark):
    words = "cal gal eal qal cai gai eai".split()  # one look
    model = scans.looks(spark.createDataFrame([(w, 90.0 - k, True) for k, w in enumerate(words)], "word string, weight double, clean boolean"))
    row = scans.options_of(spark.createDataFrame([("ea1",)], "word string"), model).first()
    assert [o["cand"] for o in row["opts"]] == words
    weights = {o["cand"]: o["weight"] for o in row["opts"]} | {"ea1": 1e-3}
    assert scans.decode(["um", "ea1"], {"ea1": weights}, {("um", "eai"): 500}, scans.Channel()) == ["um", "eai"]


def test_confusions_are_learned(spark):
    assert scans.pieces("rernetido", "remetido") == (("rn", "m"),) and scans.pieces("prec0", "preço") == (("c", "ç"), ("0", "o"))
    first = spark.createDataFrame([("rernetido", [(90.0, "remetido")], 0.05), ("cornarca", [(70.0, "comarca")], 0.1), ("eal", [(30.0, "cal"), (29.0, "gal")], 0.1)], "word string, opts array<struct<weight: double, cand: string>>, own double")
    words = spark.createDataFrame([("rernetido", 3), ("cornarca", 2), ("eal", 9), ("muito", 500), ("comum", 250)], "word string, n bigint")
    counts, held = scans.learn_channel(first, words)
    assert counts == {("rn", "m"): 5} and held["m"] == 1000
    channel = scans.Channel(counts, held)
    assert scans.Channel()["cornarca", "comarca"] > channel["cornarca", "comarca"] > scans.Channel({}, held)["cornarca", "comarca"]
    options = {"cornarca": {"cornarca": 0.1, "comarca": 40.0}}
    assert scans.decode(["cornarca"], options, {}, channel) == ["comarca"]
    held_by = {"comarca": 40.0, "cornarca": 0.5}
    assert scans.own_weight("cornarca", 0.5, False, held_by, channel) == 1e-3 < scans.own_weight("cornarca", 0.5, True, held_by, channel) == 0.5
    rare = scans.Channel({("rn", "m"): 5}, {"m": 10_000_000})  # a confusion that hardly ever happens
    assert scans.decode(["cornarca"], options, {}, rare) == ["cornarca"]


def test_long_headers_marks_and_words(spark):
    head = "Processo de arbitragem entre a reclamante e as demais partes citadas nos autos"
    body = "O consumidor pediu a reparação do contador instalado na habitação e o tribunal recordou a matéria-prima já paga pelo consumidor nos termos da lei"
    lines = [x for n in range(1, 6) for x in (head, f"{body} {n}", f"{n} {body}", f"Ainda {n} {body}", f"Enfim {n} {body}", f"{'-' * 20} {123450 + n} {'-' * 20}")]
    pages = spark.createDataFrame([(f"s{i}", "\n".join(lines)) for i in range(4)], "rel string, text string")
    got = {(r["line_no"], r["kind"]) for r in scans.furniture(pages).filter("rel = 's1'").collect()}
    assert got == {(i + 1, "header") for i, x in enumerate(lines) if x == head} | {(i + 1, "page_number") for i, x in enumerate(lines) if x[0] == "-"}
    long = "x" * 200
    assert {r["word"]: r["n"] for r in scans.word_counts(spark.createDataFrame([(f"{long} {long}, sub-{long}",)], "t string")).collect()} == {long: 3, f"sub-{long}": 1, "sub": 1}


def test_rows_of_page_marks():
    def scan(numbers: list) -> tuple[list[str], set[int]]:
        lines = [x for n in numbers for x in ("um texto", "mais texto", "e ainda", "fim", str(n))]
        return lines, {i for i in range(4, len(lines), 5) if lines[i] != "#~"}

    for numbers in (range(1, 520), range(37, 45), [1, 2, "#~", 4, 5], [37, 38, "#~", "#~", 41], [f"{n}/1200" for n in range(1, 9)], range(1190, 1206)):
        lines, want = scan(list(numbers))
        assert set(scans.marks(lines)) == want
    assert not scans.marks(["a", "5", "6", "7", "8", "b"]) and not scans.marks(["a", "x", "y", "z", "45/2019", "b", "c", "d", "e"])


def test_pairs_of_a_text_against_a_plain_count():
    table = np.full(scans.BITS // 8, 255, np.uint8)
    text = "O prazo de 30 dias, guarda-roupa\nfim\n\nA-b c@se  12-a  \té 2020 ½x\r\nÉ-\n- -a b-- c"
    want: Counter = Counter()
    for line in text.lower().split("\n"):
        words = scans.parts_of(line)
        want.update(zip(words, words[1:]))
    assert Counter(scans.known_pairs(text, table, scans.Tokens())) == want and want["prazo", "de"] == 1 and want["de", "dias"] == 1


def test_signs_and_repetitions_cost_no_token_or_pair_of_their_own():
    table, tokens = np.full(scans.BITS // 8, 255, np.uint8), scans.Tokens()
    text = "\n".join(f"o prazo, (o prazo); o prazo: {k % 30}.{k % 31},{k % 7} «o prazo»" for k in range(1000))
    got = scans.known_pairs(text, table, tokens)
    assert got == {("o", "prazo"): 4000, ("prazo", "o"): 3000}
    assert len(tokens) < 60


def test_bytes_hold_the_same_words_and_looks():
    for c in [*range(1, 0x3000), 0xFB01, 0x1D400]:
        for text in (f"a{chr(c)}b", f"1{chr(c)}2 {chr(c)}", f"x-{chr(c)}y {chr(c)}@q", f"Ano-{chr(c)}"):
            words = scans.bare(text).split()
            assert [w for x in words for w in scans.WORD.findall(x.decode())] == scans.WORD.findall(text.lower()), c
            assert [w for x in words for w in scans.parts_of(x.decode())] == scans.parts_of(text), c
            if len(f"{chr(c)}x".splitlines()) == 1:
                assert scans.fold_lines([text, "Mnudhw ½ «ñ»", ""]) == [scans.fold(text), scans.fold("Mnudhw ½ «ñ»"), ""], c
    assert scans.fold_lines([]) == []


def test_records_of_lists():
    rows = pa.array([[{"a": "x", "n": 1}, {"a": None, "n": 2}], None, [], [{"a": "y", "n": 3}]])
    assert list(scans.records(rows)) == [[("x", 1), (None, 2)], [], [], [("y", 3)]]
    assert list(scans.records(rows[1:])) == [[], [], [("y", 3)]] and list(scans.records(rows[:0])) == []


def test_pairs_of_more_tokens_than_are_held():
    table, tokens = np.full(scans.BITS // 8, 255, np.uint8), scans.Tokens()
    many = [f"p{k}x" for k in range(300_001)]
    for text in (" ".join(many), "o prazo de 30 dias\nfim do prazo", " ".join(many[::-1]), "o prazo de 30 dias\nfim do prazo"):
        want: Counter = Counter()
        for line in text.split("\n"):
            words = scans.parts_of(line)
            want.update(zip(words, words[1:]))
        assert Counter(scans.known_pairs(text, table, tokens)) == want
    assert len(tokens) < 20 and len(tokens.words) < 20


def test_pairs_count_in_all_pages(spark):
    clean = [(f"c{i}", "a cela do preso.\na gela do frigorifico.") for i in range(20)] + [("once", "uma cela vazia."), ("n", None)]
    scanned = spark.createDataFrame([("s", "uma eela vazia")], "rel string, text string")
    pages = spark.createDataFrame(clean + [("s", "uma eela vazia")], "rel string, text string")
    tokens = spark.createDataFrame([("s", 1, k, w) for k, w in enumerate("uma eela vazia".split())], "rel string, line_no bigint, at int, word string")
    doubtful = spark.createDataFrame([("eela", [("cela",), ("gela",)])], "word string, opts array<struct<cand: string>>")
    (row,) = scans.pair_counts(pages, scanned, tokens, tokens.select("rel", "line_no").distinct(), doubtful).collect()
    assert {(p["a"], p["b"]): p["n"] for p in row["pairs"]} == {("uma", "cela"): 1.0, ("cela", "vazia"): 1.0, ("uma", "eela"): scans.SCANNED, ("eela", "vazia"): scans.SCANNED}


def test_scan_noise(spark):
    body = "O consumidor pediu a reparação do contador e o tribunal recordou a matéria-prima ao consumidor"
    clean = [(f"c{i}", body + ".\n" + body) for i in range(40)]
    page = "\n".join(["Tribunal Novo · cópia", "O consumidor pediu a repa-", "ração do c0ntador e o", "Pág. 1/2", "Tribunal Novo · cópia", "tribunal recordoii a matéria-", "prima ao consumidor.", "Pág. 2/2"])
    rows = clean + [(f"s{i}", page) for i in range(5)] + [("s0", page), ("sn", None), ("sb", "  ")]
    pages = spark.createDataFrame([(k, t, "q") for k, t in rows], "rel string, text string, look string").select("rel", "text")
    scanned = spark.createDataFrame([(f"s{i}",) for i in range(5)] + [("sn",), ("sb",), ("absent",)], "rel string")
    cases, repairs = scans.scan_noise(pages, scanned)
    got = {(r["line_no"], r["kind"]) for r in cases.filter(F.col("rel_raw") == "s3").collect()}
    assert got == {(1, "header"), (5, "header"), (4, "page_number"), (8, "page_number"), (2, "hyphen"), (3, "char"), (6, "char")}
    text = {r["rel_raw"]: r["text"] for r in scans.clean_text(pages.filter("rel like 's%'"), cases, repairs).collect()}
    assert text["s3"] == body + "." and text["sn"] is None
    assert scans.scan_noise(pages, scanned.limit(0))[0].count() == 0
    assert scans.scan_noise(pages.limit(0), scanned)[0].count() == 0
