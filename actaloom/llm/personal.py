"""Personal information inside free text.

Method: bootstrapped contextual extraction. One pass over the texts finds candidates by
shape (mail and street addresses, numbers, names) with the tokens before and after them.
Sure shapes and labels are seeds: a mail address with its sign and its points, a street word
with name and number, a number with a country prefix, a card number with its letters, a name
after a title. Seeds induce lexical patterns (the tokens on either side); Spark scores the
graph of patterns and instances (addresses; numbers, a country's prefix left out; the tokens of
names) in rounds until it grows no more: a pattern by the share of its instances that are
trusted, an instance by its trusted patterns. Trusted patterns then admit identifiers that no
seed has - loosely written mail addresses, addresses without a street word, numbers without
a label, names - and trusted name tokens tell where a name begins and ends.

Only candidates are shuffled, never texts. The graph lives in DataFrames, its lineage is
cut each round. Trusted patterns and the lexicon of name tokens are broadcast to the candidates
while they are fewer than `FEW`, so that a pattern or a name of a third of all rows meets no
task as a whole; more of them are joined by a shuffle. Counts are aggregated before each
exchange.

Defined cases: null and blank texts have no candidates; repeated pages count once; every
mention counts; a candidate inside a mail address or a street address is none; names of
companies (a sign or form of company beside them) are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actaloom.operators.texts import one_text
from actaloom.session import cut, spread, stored

#: Rounds of scoring at most; trust that a pattern needs for numbers (whose seeds are few), for addresses
#: (whose seeds are nearly all) and for names; trusted patterns that make an instance trusted.
ROUNDS, NUMBER_TRUST, PLACE_TRUST, NAME_TRUST, NUMBER_SUPPORT, NAME_SUPPORT = 6, 0.15, 0.5, 0.6, 1, 2

EMAIL = re.compile(r"[\w.+-]+(?:@|\s?[(\[{]\s?(?:at|arroba|@)\s?[)\]}]\s?| arroba )(?:[\w-]+(?:\.| ?[(\[](?:dot|ponto|\.)[)\]] ?))+[A-Za-z]{2,}")
MAIL_SIGN = re.compile(r"[(\[{]\s?(?:at|arroba|@)\s?[)\]}]|@|\s(?:arroba|at)\s", re.I)
#: Like a mail address, but with blanks or words where it has signs.
LOOSE_MAIL = re.compile(r"[\w.+-]+\s?(?:@|[(\[{]\s?(?:at|arroba|@)\s?[)\]}]|(?<=\s)(?:at|arroba)(?=\s))\s?[\w-]+(?:(?:\s?\.\s?|\s(?:dot|ponto)\s|\s?[(\[](?:dot|ponto|\.)[)\]]\s?)[\w-]+)*?(?:\s?\.\s?|\s(?:dot|ponto)\s|\s?[(\[](?:dot|ponto|\.)[)\]]\s?)[A-Za-z]{2,}\b", re.I)
CAP, GAP = r"[A-ZÀ-ÖØ-Þ]", r"(?:[^\S\n]+|[^\S\n]*\n[^\S\n]*)"
PLACE = rf"{CAP}[\w'’-]*(?:[^\S\n]+(?:d[aoe]s?[^\S\n]+)?{CAP}[\w'’-]*)*"
#: Words that begin a street's name. Fixed values.
STREET_WORDS = "Rua R. Avenida Av. Aven. Estrada Estr. Praceta Pct. Praça Pç. Travessa Tv. Trav. Beco Largo Lg. Alameda Al. Calçada Rotunda Caminho Azinhaga Urbanização Urb. Bairro RUA AVENIDA ESTRADA PRACETA PRAÇA TRAVESSA BECO LARGO ALAMEDA".split()


def beginning(words: list[str]) -> str:
    """A pattern for words that begin a word; it starts with their first letters, which a search skips to."""
    firsts = sorted({w[0] for w in words})
    return "|".join(rf"{c}(?<!\w{c})(?:{'|'.join(re.escape(w[1:]) for w in words if w[0] == c)})" for c in firsts)


STREET = re.compile(
    rf"(?:{beginning(STREET_WORDS)})"
    rf"{GAP}(?:(?:d[aoe]s?|DA|DO|DE|DAS|DOS){GAP})?(?:\d+{GAP}de{GAP})?{CAP}[\w'’.-]*(?:{GAP}(?:(?:d[aoe]s?|e|DA|DO|DE|DAS|DOS){GAP})?{CAP}[\w'’-]*)*"
    rf",?{GAP}(?:(?:n\.?[ºo°]|nº|N\.?º|lote|Lote|porta){GAP}?)?\d+[A-Z]?\b"
    rf"(?:(?:,|{GAP}-){GAP}\d+\.?[ºª](?:{GAP}(?:andar|Esq\.?|Dto\.?|Dt\.?|Fte\.?|[A-Z]\b))?|,?{GAP}(?:r/c|R/C|fração{GAP}[A-Z]\b|cave|sub-?cave|loja{GAP}[A-Z0-9]+)(?:{GAP}(?:Esq\.?|Dto\.?))?)*"
    rf"(?:,?{GAP}\d{{4}}[^\S\n]?[-–][^\S\n]?\d{{3}}(?:{GAP}{PLACE})?)?"
)
#: A postal code, and what stands before it where a street word is missing.
POSTAL = re.compile(rf"\d{{4}}[^\S\n]?[-–][^\S\n]?\d{{3}}(?!\d)(?:{GAP}{PLACE})?")
LOOSE_STREET = re.compile(rf"{CAP}[\w'’.-]*(?:[^\S\n]+(?:(?:d[aoe]s?|e)[^\S\n]+)?{CAP}[\w'’-]*)*,?[^\S\n]+(?:n\.?[ºo°][^\S\n]?)?\d+[A-Z]?,?{GAP}$")
#: Numbers that may be a telephone's or a person's: digits in groups, with what may stand before and after.
BEFORE, GROUPS = r"[\w.,/+(€$-]", r"(?:[ .-]?\d){7,10}(?:[ -]?[A-Z]{2}\d)?(?![\w/]|[.,-]\d)"
NUMBER = re.compile(
    rf"(?:\((?<!{BEFORE}\()\+\d{{1,3}}\)[ .-]?|\+(?<!{BEFORE}\+)\d{{1,3}}[ .-]?|0(?<!{BEFORE}0)0351[ .-]?)\d{GROUPS}"
    rf"|\d(?<!{BEFORE}\d){GROUPS}|[A-Z](?<!\w[A-Z])[A-Z]\d{{6}}(?!\w)"
)
PARTICLE = r"(?:d[aoe]s?|e|y|DA|DO|DE|DAS|DOS|E|D['’])"
WORD = rf"(?:{CAP}[a-zà-öø-ÿ]+(?:['’-]{CAP}[a-zà-öø-ÿ]+)*|{CAP}{{2,}}|{CAP}\.(?=\s))"
FIRST = rf"{CAP}(?<![\w@.&-]{CAP})(?:[a-zà-öø-ÿ]+(?:['’-]{CAP}[a-zà-öø-ÿ]+)*|{CAP}+|\.(?=\s))"  # WORD, its first letter in front
NAME = re.compile(rf"{FIRST}(?:,?{GAP}(?:{PARTICLE}{GAP})?{WORD})+(?![\w@])")
TOKEN = re.compile(r"[^\W\d_]+(?:[.'’][^\W\d_]+)*\.?[ºª]?|\d+|[^\w\s]")
SENTENCE = re.compile(r"\w{6,}\.$|[!?]$")
#: Titles and forms of company. Fixed values.
TITLES = set("sr. sra. sr.ª srs. dr. dra. dr.ª eng. eng.º eng.ª engº prof. prof.ª profª arq. arq.º dona dom ms mr mrs ms. mr. mrs. mme".split())
COMPANY = re.compile(r"\s*(?:&|,?\s*(?:Lda|LDA|Ltda|S\.\s?A|SA\b|Unipessoal|Irmãos|e\s+Filhos|Filhos|S\.L|Ltd|Inc|GmbH|S\.A\.R\.L|Portugal\b|Sucessores|Sociedade|Grupo))")
PHONE_LABELS = set("tel. telef. telefone tlm. telemóvel telm. tlf. teléfono contacto telefónico fax móvil phone".split())
ID_LABELS = re.compile(r"(?:\bn\.?\s?i\.?\s?f\.?:?|\bnif:?|contribuinte(?: fiscal)?(?: n\.?º)?:?|cidadão(?: n\.?º)?:?|\bb\.?\s?i\.?:?|identidade(?: n\.?º)?:?|\bn\.?i\.?s\.?s\.?:?|\bcc:?|passaporte(?: n\.?º)?:?|benefici[áa]ri[oa](?: n\.?º)?:?)\s*(?:n\.?º\s*)?$", re.I)


def tokens(text: str) -> list[str]:
    return ["0" if t.isdigit() else t.lower() for t in TOKEN.findall(text)]


def around(text: str, a: int, b: int) -> tuple[str, str]:
    """The patterns of a mention: two tokens before it and two after it, on its own lines and in its sentence."""
    begin, end, size = text.rfind("\n", 0, a) + 1, text.find("\n", b), 40
    end = len(text) if end < 0 else end
    while True:  # the last pieces between blanks tell; long ones are rare
        part = text[max(begin, a - size) : a].split()
        if len(part) > 3 or a - size <= begin:
            break
        size *= 4
    left = tokens(" ".join(part[-2:]))
    left = (left if len(left) >= 2 else tokens(" ".join(part)))[-2:]
    if left and SENTENCE.search(left[-1]):
        left = []
    size, right = 40, []
    while True:
        right = tokens(" ".join(text[b : min(end, b + size)].split()[:3]))
        if len(right) > 2 or b + size >= end:
            break
        size *= 4
    return " ".join(left), " ".join(right[:2])


def label_before(text: str, a: int) -> bool:
    """Whether the label of an identity number stands before a; labels are no longer than 40 characters."""
    while a and text[a - 1].isspace():
        a -= 1
    return bool(ID_LABELS.search(text[max(0, a - 40) : a]))


def number_kinds(s: str) -> tuple[bool, bool, str]:
    """(may be a telephone, may be an identity number, sure kind or "") by digits and signs."""
    digits = re.sub(r"\D", "", s)
    prefix = s[0] in "(+" or s.startswith("00351")
    letters = bool(re.search(r"[A-Z]", s))
    if prefix:
        return len(digits) in (11, 12, 13, 14), False, "phone" if len(digits) in (11, 12, 13, 14) else ""
    if letters:
        return False, True, "id_number"
    card = re.fullmatch(r"\d{8}(?:[ -]?\d)?", s)
    return len(digits) == 9 and digits[0] in "239", bool(card) or len(digits) in (9, 11) and bool(re.fullmatch(r"\d{3}([ .]?)\d{3}\1\d{3}|\d{11}", s)), ""


CANDS = "rel string, kind string, start int, text string, left string, right string, seed string, may string"


def candidates(pages: DataFrame, rel: str, text: str) -> DataFrame:
    """Candidates of every page, see CANDS. seed: the sure kind of a mention, or ""."""

    def page(key: str, t: str) -> Iterator[tuple[str, str, int, str, str, str, str, str]]:
        held: list[tuple[int, int]] = []
        for sign in MAIL_SIGN.finditer(t):
            a = sign.start()
            while a > 0 and t[a - 1].isspace() and sign.start() - a < 1:
                a -= 1
            while a > 0 and (t[a - 1].isalnum() or t[a - 1] in "._+-"):
                a -= 1
            if held and a < held[-1][1]:
                continue
            if m := EMAIL.match(t, a):
                held.append(m.span())
                yield key, "email", m.start(), m.group(), *around(t, *m.span()), "email", "email"
            else:
                a = len(t[: sign.start()].rstrip()) if sign.start() < 4096 else sign.start() - 4096 + len(t[sign.start() - 4096 : sign.start()].rstrip())
                while a > 0 and (t[a - 1].isalnum() or t[a - 1] in "._+-"):
                    a -= 1
                if (m := LOOSE_MAIL.match(t, a)) and (not held or a >= held[-1][1]):
                    yield key, "email", m.start(), m.group(), *around(t, *m.span()), "", "email"
        for m in STREET.finditer(t):
            held.append(m.span())
            yield key, "address", m.start(), m.group(), *around(t, *m.span()), "address", "address"
        free = lambda a, b: all(b <= x or a >= y for x, y in held)
        for m in POSTAL.finditer(t):
            if free(*m.span()):
                before = t.rfind("\n", 0, max(0, t.rfind("\n", 0, m.start()))) + 1  # its line and the one before
                if (p := LOOSE_STREET.search(t, max(before, m.start() - 400), m.start())) and free(p.start(), m.end()):
                    yield key, "address", p.start(), t[p.start() : m.end()], *around(t, p.start(), m.end()), "", "address"
        for m in NUMBER.finditer(t):
            phone, ident, sure = number_kinds(m.group())
            if (phone or ident) and free(*m.span()):
                left, right = around(t, *m.span())
                last = left.rsplit(" ", 1)[-1]
                if not sure and phone and (last in PHONE_LABELS or left.endswith("tel. :")):
                    sure = "phone"
                elif not sure and ident and label_before(t, m.start()):
                    sure = "id_number"
                yield key, "number", m.start(), m.group(), left, right, sure, "phone " * phone + "id_number" * ident
        for m in NAME.finditer(t):
            begin, end = m.span()
            end = min([end, *(x for x, _ in held if x > begin)])  # up to a street that follows on the next line
            if COMPANY.match(t, end):
                end = max(begin, t.rfind("\n", begin, end))
            part = NAME.match(t, begin, end) if end < m.end() else m
            if part and free(*part.span()) and not t[max(0, begin - 3) : begin].rstrip().endswith("&"):
                left, right = around(t, *part.span())
                last = left.rsplit(" ", 1)[-1]
                yield key, "name", begin, part.group(), left, right, "person" if last in TITLES else "", "person"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
        for b in batches:
            rows = [c for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if k is not None and t is not None for c in page(k, t)]
            cols = list(zip(*rows)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cols, types)], names=[c.split()[0] for c in CANDS.split(", ")])

    return spread(pages.select(F.col(rel).cast("string"), F.col(text).cast("string"))).mapInArrow(run, CANDS)


#: Trusted patterns, and name tokens, up to which they are broadcast (some 60 bytes each).
FEW = 500_000


def small(df: DataFrame) -> DataFrame:
    """df, written, and marked for broadcast if it has FEW rows at most."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW else df


def rounds(edges: DataFrame, seeds: DataFrame, least: Column, support: int) -> tuple[DataFrame, DataFrame]:
    """(trusted patterns: pattern, kind, trust; trusted instances: item, kind).

    edges: (pattern, item) without repetition; seeds: (item, kind). A pattern's trust in a
    kind is the share of its distinct instances that are trusted, of which there must be
    two, and has to reach `least`; an instance is trusted if it is a seed or `support` trusted
    patterns hold it. Rounds follow until no instance joins, ROUNDS at most.
    """
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    items = seeds = cut(seeds.select("item", "kind").distinct())
    known = items.count()
    for _ in range(ROUNDS):
        score = edges.join(items, "item").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("good"))
        trusted = score.join(sizes, "pattern").withColumn("trust", F.col("good") / F.col("n")).filter((F.col("good") >= 2) & (F.col("trust") >= least))
        trusted = cut(trusted.select("pattern", "kind", "trust"))
        reached = edges.join(trusted, "pattern").groupBy("item", "kind").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
        items = cut(reached.select("item", "kind").union(seeds).distinct())
        if (now := items.count()) == known:
            break
        known = now
    return trusted, items


def sides(cands: DataFrame, *keep: Column) -> DataFrame:
    """Each candidate with its pattern on the left and the one on the right."""
    telling = r"\p{L}{3}|\p{L}\."  # a pattern needs a word; one that only closes the sentence tells nothing
    both = F.array(
        F.when(F.col("left").rlike(telling), F.concat(F.lit("< "), "left")),
        F.when(F.col("right").rlike(telling) & ~F.col("right").rlike(r"^[.;!?]"), F.concat(F.lit("> "), "right")),
    )
    return cands.select(*keep, F.explode(both).alias("pattern")).filter(F.col("pattern").isNotNull())


def instance() -> Column:
    """What makes two mentions one instance: an address in small letters, a number's signs, a country's prefix left out."""
    digits = F.regexp_replace("text", "[ .()-]", "")
    return F.when(F.col("kind") == "number", F.regexp_replace(digits, r"^(?:\+|00)351(?=\d{9}$)", "")).otherwise(F.lower("text"))


def identifiers(cands: DataFrame) -> DataFrame:
    """(rel, kind, text, start) of mail and street addresses, telephone and identity numbers."""
    n = cands.filter(F.col("kind") != "name").withColumn("item", instance())
    edges = sides(n, F.col("item")).distinct()
    seeds = n.filter(F.col("seed") != "").select("item", F.col("seed").alias("kind"))
    least = F.when(F.col("kind").isin("email", "address"), PLACE_TRUST).otherwise(NUMBER_TRUST)
    best = small(rounds(cut(edges), seeds, least, NUMBER_SUPPORT)[0].groupBy("pattern").agg(F.max_by("kind", "trust").alias("found"), F.max("trust").alias("trust")))
    open_ = n.filter(F.col("seed") == "")
    near = sides(open_, F.col("rel"), F.col("start"), F.col("text"), F.col("may")).join(best, "pattern").filter(F.col("may").contains(F.col("found"))).groupBy("rel", "start", "text").agg(F.max_by("found", "trust").alias("kind"))
    sure = n.filter(F.col("seed") != "").select("rel", F.col("seed").alias("kind"), "text", "start")
    return sure.unionByName(near.select("rel", "kind", "text", "start"))


def runs_of(text: str, known: dict[str, tuple[bool, bool]]) -> Iterator[tuple[int, int]]:
    """The places of the names within a candidate: longest runs of known tokens, inverted names included.

    known: token -> (stands first in names, stands last in names).
    """
    parts = [(m.start(), m.end(), m.group()) for m in re.finditer(WORD, text)]
    run: list[tuple[int, int, str]] = []

    def given(w: str) -> bool:
        return known.get(w.casefold(), (False, False))[0]

    def family(w: str) -> bool:
        return known.get(w.casefold(), (False, False))[1]

    def close() -> Iterator[tuple[int, int]]:
        words = [p for p in run if not p[2].endswith(".")]
        if not words or len(run) < 2:
            return
        commas = [k for k in range(1, len(run)) if "," in text[run[k - 1][1] : run[k][0]]]
        if commas:
            cut_at = commas[0]
            head, tail = run[:cut_at], run[cut_at : commas[1] if len(commas) > 1 else None]
            inverted = not any(given(p[2]) and not family(p[2]) for p in head) and tail and given(tail[0][2])
            if inverted:
                yield head[0][0], tail[-1][1]
                return
            for piece in (head, tail):
                if len(piece) >= 2:
                    yield piece[0][0], piece[-1][1]
            return
        yield run[0][0], run[-1][1]

    for p in parts:
        w = p[2]
        initial = w.endswith(".") and len(w) == 2 and "\n" not in text[p[1] : p[1] + 2]
        if run and "\n" in text[run[-1][1] : p[0]] and (initial or len(run) > 1 and family(run[-1][2]) and given(w) or "," in text[run[-1][1] : p[0]]):
            yield from close()
            run = []
        if (w.casefold() in known or initial) and w.casefold() not in TITLES:
            run.append(p)
        else:
            yield from close()
            run = []
    yield from close()


def people(cands: DataFrame) -> DataFrame:
    """(rel, kind, text, start) of persons' names."""
    named = cands.filter(F.col("kind") == "name")
    words = F.filter(F.split(F.regexp_replace("text", r"(?<!\p{L})(?:d[aoe]s?|e|y|DA|DO|DE|DAS|DOS|E)(?!\p{L})|[,]", " "), r"\s+"), lambda w: (F.length(w) > 2) & ~w.endswith("."))
    toks = F.transform(words, lambda w: F.lower(w))
    # what runs over a line end may be two things, so it is found by the lexicon but teaches nothing
    n = named.filter(~F.col("text").contains("\n")).select("rel", "start", "text", "left", "right", "seed", toks.alias("toks")).filter(F.size("toks") > 0)
    edges = cut(sides(n, F.explode("toks").alias("item")).distinct())
    seeds = n.filter(F.col("seed") != "").select(F.explode("toks").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("item", F.lit("person").alias("kind"))
    trusted, reached = rounds(edges, seeds, F.lit(NAME_TRUST), NAME_SUPPORT)
    good, reached = small(trusted.select("pattern", "trust")), small(reached.select("item"))
    # a mention is trusted by its title or one of its patterns; a token by the share of its distinct mentions that are
    trusted = sides(n, F.col("rel"), F.col("start")).join(good, "pattern").groupBy("rel", "start").agg(F.max("trust").alias("trust"), F.count_distinct("pattern").alias("sure"))
    scored = n.join(trusted, ["rel", "start"], "left").withColumn("trust", F.when(F.col("seed") != "", 1.0).otherwise(F.coalesce("trust", F.lit(0.0))))
    texts = scored.groupBy("text").agg(F.max("trust").alias("trust"), F.max(F.coalesce("sure", F.lit(0))).alias("sure"), F.first("toks").alias("toks"))  # a phrase counts once, however frequent
    each = texts.select(F.posexplode("toks").alias("at", "item"), F.size("toks").alias("size"), "trust", "sure", "text")
    hit = F.col("trust") >= NAME_TRUST
    lexicon = (
        each.groupBy("item")
        .agg(
            F.sum(hit.cast("int")).alias("good"),
            F.count(F.lit(1)).alias("n"),
            F.max("sure").alias("sure"),  # trusted patterns on both sides admit a token met once
            F.sum((hit & (F.col("at") == 0) & ~F.col("text").contains(",")).cast("int")).alias("first"),
            F.sum((hit & (F.col("at") == F.col("size") - 1) & (F.col("at") > 0) & ~F.col("text").contains(",")).cast("int")).alias("last"),
        )
        .filter((F.col("good") >= 2) & (F.col("good") >= F.lit(0.1) * F.col("n")) | (F.col("sure") >= 2) & (F.col("good") >= F.lit(0.5) * F.col("n")))
        .join(reached, "item", "left_semi")
        .select("item", (F.col("first") > F.col("last")).alias("given"), (F.col("last") >= F.col("first")).alias("family"))
    )
    lexicon = small(lexicon)
    every = F.array_distinct(F.transform(F.filter(F.split(F.regexp_replace("text", r"[,\s]+", " "), " "), lambda w: F.length(w) > 1), lambda w: F.lower(w)))
    flags = named.select("rel", "start", "text", F.explode(every).alias("item")).join(lexicon, "item").groupBy("rel", "start", "text").agg(F.collect_list(F.struct("item", "given", "family")).alias("known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rel, start, text, known in zip(b["rel"], b["start"], b["text"], b["known"]):
                lex = {k["item"]: (k["given"], k["family"]) for k in known}
                out += [(rel, "person", text[i:j], start + i) for i, j in runs_of(text, lex)]
            yield pd.DataFrame(out, columns=["rel", "kind", "text", "start"])

    return flags.select("rel", "start", "text", "known").mapInPandas(run, "rel string, kind string, text string, start int")


def mentions(pages: DataFrame, rel: str, text: str) -> DataFrame:
    """(rel, kind, text, start): every mention. Kinds: email, phone, id_number, address, person."""
    cands = stored(candidates(pages, rel, text), "candidates")
    return identifiers(cands).unionByName(people(cands))


def personal_information(pages: DataFrame, rel: str, text: str) -> DataFrame:
    """(rel_raw, kind, found_text): distinct values of each page."""
    return mentions(pages, rel, text).select(F.col("rel").alias("rel_raw"), "kind", F.col("text").alias("found_text")).distinct()


def redact(pages: DataFrame, rel: str, text: str, found: DataFrame) -> DataFrame:
    """(rel_raw, text): each page once, every mention replaced by its kind in square brackets, all else unchanged.

    found: mentions of these pages. They are replaced at their places, so that an equal string
    within the name of a company or a street stays; of mentions that overlap the longer one counts.
    """
    places = found.groupBy("rel").agg(F.collect_set(F.struct("start", "kind", "text")).alias("places"))
    rows = one_text(pages, rel, text).dropDuplicates(["rel"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, places in zip(b["text"], b["places"]):
                if t is not None and places is not None and len(places):
                    done, parts = 0, []
                    for p in sorted(places, key=lambda p: (p["start"], -len(p["text"]), p["kind"])):
                        a, z = p["start"], p["start"] + len(p["text"])
                        if a >= done and t[a:z] == p["text"]:
                            parts += [t[done:a], f"[{p['kind'].upper()}]"]
                            done = z
                    t = "".join([*parts, t[done:]])
                out.append(t)
            yield pd.DataFrame({"rel_raw": b["rel"], "text": out})

    return rows.join(places, "rel", "left").select("rel", "text", "places").mapInPandas(run, "rel_raw string, text string")
