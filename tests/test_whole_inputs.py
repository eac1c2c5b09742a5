"""Registered queries take whole tables in."""

from marlstone.plans import catalogue
from marlstone.plans.registry import table


def test_joins_and_seams_take_all_events(spark, sf_dir):
    ids = {r.event_id for r in table(spark, sf_dir, "events").select("event_id").collect()}
    last = max(ids)
    found = {n: [r[c] for r in catalogue.QUERIES[n](spark, sf_dir).select(c).collect()] for n, c in (("j21_null_equal_join", "a"), ("s14_seam", "event_id"), ("s4_facts_window", "event_id"))}
    assert sorted(found["j21_null_equal_join"]) == sorted(ids) == sorted(found["s14_seam"])
    assert sorted(found["s4_facts_window"]) == sorted(i for i in ids if 100 < i <= last - 150)


def test_encode_decode_takes_whole_texts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert {r.doc_id: r.t for r in catalogue.QUERIES["f16_encode_decode"](spark, sf_dir).collect()} == texts
