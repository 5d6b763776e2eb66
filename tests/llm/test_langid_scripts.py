"""Texts in scripts of no learned language."""

from ledgerloom.llm import langid


def test_scripts_that_no_language_uses_score_nothing(frame):
    learned = [(i, t, lang, "a") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    greek = "\u03b7 \u03b3\u03ac\u03c4\u03b1 \u03ba\u03b1\u03b9 \u03bf \u03c3\u03ba\u03cd\u03bb\u03bf\u03c2"
    rows = [(100, greek, None, "a"), (101, "the dog " + greek, None, "a"), (102, greek[:6] + " the cat and the dog", None, "a")]
    docs = frame(learned + rows)
    score = {r.doc_id: r.score for r in langid.identify(docs).collect()}
    assert score[100] == 0 and 0 < score[101] < 0.5 <= score[102] < 1
    kept = {r.doc_id for r in langid.drop_unidentified(docs, least=0.5).collect()}
    assert kept == {*range(40), 102}
