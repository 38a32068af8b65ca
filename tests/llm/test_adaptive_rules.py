"""Quality rules against plain versions of the counts and thresholds."""

import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import ODD

from quern.llm import adaptive_rules as rules


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)) if words else 0, len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab #|\n\t\x0b é\x85　"), max_size=60))
def test_counts(text):
    assert rules.measure(text) == plain(text)


def bucket(rate):
    return math.ceil(math.log(rate) / math.log(1.01 / 0.99))


def fence(values):
    """The bucket of the upper fence."""
    b = sorted(map(bucket, values))
    q1, q3 = (b[math.ceil(len(b) * q) - 1] for q in (0.25, 0.75))
    return q3 + 3 * (q3 - q1)


def text_of(i, symbols=0):
    words = [f"w{(i * 37 + j * 101) % 997}" for j in range(60 + i % 20)]
    return " ".join(w + "#" * (j < symbols) for j, w in enumerate(words))


def test_thresholds_follow_groups_and_their_parents(docs_of):
    rows = [(i, text_of(i, symbols=i % 5), "en", "big") for i in range(80)] + [(100 + i, text_of(i), "en", "small") for i in range(5)] + [(200, text_of(3), None, None)]
    stats = rules.document_stats(docs_of(rows))
    got = {(r["lang_key"], r["source_key"]): r for r in rules.thresholds(rules.sketches(stats)).collect()}
    rate = lambda r: (plain(r[1])[2] + 1) / (plain(r[1])[0] + 1)
    groups = {("=en", "=big"): rows[:80], ("=en", "=small"): rows[:85], ("null", "null"): rows}
    for key, members in groups.items():
        assert got[key]["high_symbol_rate"] == fence([rate(r) for r in members])


def test_groups_of_different_rates_get_different_verdicts(docs_of):
    rows = [(1000 * g + i, text_of(i, symbols=(i % 7) * few), "en", f"s{g}") for g, few in ((0, 0), (1, 8)) for i in range(80)]
    rows += [(9000 + g, text_of(5, symbols=45), "en", f"s{g}") for g in (0, 1)]
    got = {r["doc_id"]: r["kept"] for r in rules.verdicts(docs_of(rows)).collect()}
    assert all(got[i] for i in range(80)) and all(got[1000 + i] for i in range(80))
    assert not got[9000] and got[9001]  # far outside where symbols are rare, usual where they are frequent


def test_columns_of_any_name_stay(docs_of):
    odd = docs_of([(i, text_of(i), "en", "s") for i in range(60)]).selectExpr("*", "1 AS __0", "2 AS `a.b`")
    kept = rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == 60


def test_symbols_beyond_the_fence_are_rejected_and_clean_rows_kept(docs_of):
    rows = [(i, text_of(i), "en", "s") for i in range(60)] + [(99, text_of(5, symbols=40), "en", "s"), (98, "too short", "en", "s"), (97, "a b c " * 30, "en", "s")]
    got = {r["doc_id"]: r for r in rules.verdicts(docs_of(rows)).collect()}
    assert not got[99]["kept"] and not got[99]["base_failed"]
    assert got[98]["base_failed"] and got[97]["base_failed"] and not got[97]["kept"]
    assert sum(got[i]["kept"] for i in range(60)) == 60
    kept = rules.keep_good(docs_of(rows, clash=["kept", "lang_key", "n_words"]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "lang_key", "n_words"]
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(60))


def test_odd_rows_and_empty_tables(docs_of):
    got = rules.verdicts(docs_of(ODD)).collect()
    assert len(got) == len(ODD)
    assert all((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) in {plain(t or "") for _, t, _, _ in ODD} for r in got)
    assert rules.verdicts(docs_of([])).count() == 0 and rules.keep_good(docs_of([])).count() == 0
