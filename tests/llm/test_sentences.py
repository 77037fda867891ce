from __future__ import annotations

import functools

import pandas as pd
import pytest

from actaloom.llm import sentences as S


@functools.cache
def model() -> S.Model:
    """The model of the documents at scale 0.01."""
    return S.Model(S.fit(corpus()))


@functools.cache
def corpus() -> list[str]:
    return pd.read_parquet("/root/testdata/sf0.01/documents.parquet")["text"].dropna().tolist()


CASES = {
    "O Sr. Eng.º Reis veio. A ré não.": ["O Sr. Eng.º Reis veio.", "A ré não."],
    "Comprou à Tervo, Lda. A parte pagou 1.234,56 €. Fim": ["Comprou à Tervo, Lda.", "A parte pagou 1.234,56 €.", "Fim"],
    "O Prof. A. B. Sarrabal depôs às 12.45. Vou!": ["O Prof. A. B. Sarrabal depôs às 12.45.", "Vou!"],
    "Veja-se o art. 7 e a pág. 82, p. ej., do D.L. 54/2022. Sim.": ["Veja-se o art. 7 e a pág. 82, p. ej., do D.L. 54/2022.", "Sim."],
    "Disse: “não pago. nunca!” A ré saiu.": ["Disse: “não pago. nunca!”", "A ré saiu."],
    "“Não. Nunca!”, disse ela. Foi": ["“Não. Nunca!”, disse ela.", "Foi"],
    "¡nadie me avisó! ¿Es cierto? Sí.": ["¡nadie me avisó!", "¿Es cierto?", "Sí."],
    "Cf. p. 126 et s. sur le délai.Est-il exact ? Oui.": ["Cf. p. 126 et s. sur le délai.", "Est-il exact ?", "Oui."],
    "O total é 4 €… e a caução não. Nada mais… A ré foi.": ["O total é 4 €… e a caução não.", "Nada mais…", "A ré foi."],
    "1. Do litígio sobre a Lombar, Lda.: 8 €\n \nTexto\ncontinua aqui. Fim.": ["1. Do litígio sobre a Lombar, Lda.: 8 €", "Texto\ncontinua aqui.", "Fim."],
    "申请人称：「请退钱！没有？」经过56天，他否认……他说没有。": ["申请人称：「请退钱！没有？」", "经过56天，他否认……", "他说没有。"],
    "販売店は「返してください。」と述べた。検針値は72.54kWhであった。": ["販売店は「返してください。」と述べた。", "検針値は72.54kWhであった。"],
    "ผู้ร้องเกินไป 8302 ยูโร ผู้เชี่ยวชาญเขียน": ["ผู้ร้องเกินไป 8302 ยูโร", "ผู้เชี่ยวชาญเขียน"],
    "ازداد السعر. هل صحيح؟ نعم.": ["ازداد السعر.", "هل صحيح؟", "نعم."],
    "यह सच है। नहीं था।": ["यह सच है।", "नहीं था।"],
    "veja www.portal.test desde as 17.14 h. O dono riu.": ["veja www.portal.test desde as 17.14 h.", "O dono riu."],
    "Gave it at 9.12 a.m. On reflection, no?! Yes.": ["Gave it at 9.12 a.m.", "On reflection, no?!", "Yes."],
    "Er kam z. B. erst nach 3 Tagen. „Nie. Nein“, sagte sie.": ["Er kam z. B. erst nach 3 Tagen.", "„Nie. Nein“, sagte sie."],
    "a\r\n\r\nb\r\nc": ["a", "b\r\nc"],
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert [text[a:b] for a, b in S.spans(text, model())] == CASES[text]


def test_training_learns_an_abbreviation():
    words = "contrato fatura prazo serviço tribunal reclamante contador vistoria".split()
    texts = [f"O caso foi visto.\n\nVeio o Xptq. Reis ontem à tarde.\n\nTudo sobre o {w}. Nada ficou do {v}. Segue o {w}." for w in words for v in words]
    model = S.Model(S.fit(texts))
    t = "Veio o Xptq. Reis. Saiu."
    assert [t[a:b] for a, b in S.spans(t, model)] == ["Veio o Xptq. Reis.", "Saiu."]


def test_training_decides():
    bare, trained = S.Model(S.PRIOR), model()
    a, b = ({(k, s) for k, t in enumerate(corpus()) for s in S.spans(t, m)} for m in (bare, trained))
    assert len(a ^ b) > 0.005 * len(b)
    t = "申请人称：「请退钱！」と述べた。Veja-se o art. 7 e a pág. 82."
    assert S.spans(t, bare) != S.spans(t, trained)


def test_held_out_boundaries():
    """Trained on one half, the model finds the reliable boundaries of the other."""
    texts = corpus()
    held, right, total = S.Model(S.fit(texts[::2])), 0, 0
    for key, label, n in S.reliable(texts[1::2]):
        right += n * (held[key] == bool(label))
        total += n
    assert right >= 0.98 * total


def test_every_row(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Uma. Duas."), (4, "Uma. Duas."), (5, "Longo. " * 20_000)]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id bigint, text string, start_at int")
    got = S.split_sentences(df, "doc_id", "text")
    n = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert n == {4: 4, 5: 20_000}
    assert S.split_sentences(df.limit(0), "doc_id", "text").count() == 0
