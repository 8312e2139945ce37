"""What the corpus operators find doesn't depend on unrelated words or on lengths."""

from spindrift.llm import decontaminate as D
from spindrift.llm import pii


def extra(spark, text):
    r = pii.spans_of(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    return {(x.kind, x.value) for x in r.extra}


def test_spelt_out_mail_is_found_whatever_else_the_text_holds(spark):
    for mail in ("jane at example.com", "jane at example[dot]com", "jane at example dot com", "jane(at)example.com", "jane[at]example.com"):
        assert ("email", mail) in extra(spark, f"write to {mail}, please")


def test_long_secrets_are_found_to_their_end(spark):
    value = "token=" + "aB3" * 200
    assert ("secret", value) in extra(spark, f"export {value} now")


def test_short_items_match_whole_words_exactly():
    index = D.Index([(1, "What is  DNA?"), (2, "two plus two"), (3, "cat"), (4, ""), (5, "(a)"), (6, "the first long item of the benchmark")])
    found = lambda t: {(i, d) for i, _, d in index.find(t)}
    assert found("He asked: what is dna? Then left.") == {(1, 0)}
    assert found("Two plus\ntwo") == {(2, 0)} and found("two plus twos") == found("atwo plus two") == set()
    assert found("concatenate cats") == set() and found("a cat.") == found("cat") == {(3, 0)} and found("x(a)b") == {(5, 0)}
    assert found("The first long item of the benchmark and a cat") == {(3, 0), (6, 0)}
    assert len(D.Index([(3, "cat"), (3, "cat")]).find("cat cat")) == 2
    assert found("") == found(None) == set()
