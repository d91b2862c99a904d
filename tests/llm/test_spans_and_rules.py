import random
import re
import time
from collections import Counter

from lodestar.llm import pii, quality_rules

from .hard import TEXTS, by_id, documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            valid = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}
            if valid[kind]:
                out[kind].append(m.span())
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a@.b-", "12.34+", "0 1-2.5()", "4111 1111-", "x@y.z +", "@", "é1.2"]
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 40)))
        found = pii.spans_of(text)
        assert {k: found[k] for k in PATTERNS} == brute_spans(text), text


def test_added_kinds_and_mask():
    text = 'Mail a.b@c.de, https://u:p@h.org/x or token = "ab12cd34ef"; IBAN DE89370400440532013000. A clean https://h.org/x stays, so does a token of thanks.'
    found = pii.spans_of(text)
    assert [text[a:b] for a, b in found["address"]] == ["https://u:p@h.org/x"]
    assert [text[a:b] for a, b in found["account"]] == ["ab12cd34ef", "DE89370400440532013000"]
    assert pii.masked(text).startswith('Mail <EMAIL>, <ADDRESS> or token = "<ACCOUNT>"; IBAN <ACCOUNT>. A clean https://h.org/x stays')
    assert pii.masked("nothing here, 12 or 2024") == "nothing here, 12 or 2024"


def test_values_behind_cues_are_whole():
    long = "eyJhbGciOiJIUzI1NiJ9." + "aB3-_x" * 400 + ".sig9"
    iban = "DE89 3704 0044 0532 0130 00"
    for text, values in (
        (f"token={long}, so", [long]), (f'access_key: "{long}"', [long]), ("account number: 12345678.", ["12345678"]), ("Account no. 12345678", ["12345678"]),
        ("passport number X1234567 of", ["X1234567"]), ("account_id = ab1234", ["ab1234"]), ("token id is 9876543", ["9876543"]), ("token=id_ab12cd34", ["id_ab12cd34"]),
        (f"IBAN: {iban}, BIC", [iban]), (f"iban is {iban} and more", [iban]), ("IBAN GB29 NWBK 6016 1331 9268 19", ["GB29 NWBK 6016 1331 9268 19"]), ("IBAN: DE88 3704 0044 0532 0130 00", []),
        ("account no longer than 12 lines", []), ("password" + " " * 20 + ": ab1234", ["ab1234"]), ("account token=a1b2c3", ["a1b2c3"]),
    ):
        found = pii.spans_of(text)["account"]
        assert [text[a:b] for a, b in found] == values, text
        assert all(v not in pii.masked(text) for v in values)


def test_overlapping_spans_are_masked_to_the_last_end():
    text = "account: key/4111 1111 1111 1111 or more"
    found = pii.spans_of(text)
    assert [text[a:b] for k in ("account", "card") for a, b in found[k]] == ["key/4111", "4111 1111 1111 1111"]
    assert pii.masked(text) == "account: <ACCOUNT> or more"


def test_values_take_linear_time():
    started = time.process_time()
    for text in ("token=" * 100_000, "token=" + "token-" * 100_000 + "=" * 300_000, "account number " * 50_000, "iban=de89" * 80_000):
        pii.spans_of(text)
    assert time.process_time() - started < 20


def test_urls_take_linear_time_and_equal_single_looks():
    started = time.process_time()
    for text in ("a://" * 250_000, "a://b?x=1;" * 100_000, "a://" + "b." * 500_000, "a://?user=" * 100_000 + "&"):
        pii.spans_of(text)
    assert time.process_time() - started < 20
    rng = random.Random(9)
    parts = ["a://", "://", "@", "?user=", "&sid=", ";token=x", " ", ".", ")", "b", "#", "user=", "?token=a?email=b"]
    single = re.compile(r"[?&;](?:account|acct|iban|ssn|token|session|sessionid|sid|user|uid|email)=[^&#;]+", re.I)
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want, free = [], 0
        for m in re.finditer("://", text):
            start, end = m.start(), m.end()
            while start > free and text[start - 1].isalnum():
                start -= 1
            while end < len(text) and text[end] != " ":
                end += 1
            while end > m.end() and text[end - 1] in ".,;:!?)]":
                end -= 1
            body = text[m.end() : end]
            if m.start() >= free and start < m.start() and body and ("@" in body or single.search(body)):
                want.append((start, end))
                free = end
        assert pii.spans_of(text)["address"] == want, text


def test_common_forms_of_cues():
    for text, values in (
        ("api key: sk-abc123def456", ["sk-abc123def456"]), ("passwords: abc12345", ["abc12345"]), ("my password is hunter22", ["hunter22"]), ("Authorization: Bearer abcdef1234567890", ["abcdef1234567890"]),
        ("secret key = zz91zz91", ["zz91zz91"]), ("Access keys: AKIA99887766", ["AKIA99887766"]), ("the password is secret", []), ("a bearer of news in 2024", []), ("tokenset: abc12345", []),
    ):
        assert [text[a:b] for a, b in pii.spans_of(text)["account"]] == values, text


def test_spans_of_hard_rows(spark):
    docs = documents(spark)
    rows = by_id(pii.find(docs))
    assert {i: len(r) for i, r in rows.items()} == Counter(i for i, _ in TEXTS)
    assert rows[1][0]["spans"] == "" and rows[1][0]["n_email"] == 0
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    assert by_id(masked)[1][0]["text"] is None and by_id(masked)[5][0]["text"] == TEXTS[4][1]
    assert pii.find(docs.limit(0)).count() == 0 and pii.mask(docs.limit(0)).count() == 0


def brute_statistics(text):
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words, lines = word.findall(text), [x for x in text.split("\n") if word.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_equal_brute_force(spark):
    rng = random.Random(9)
    made = [(100 + i, "".join(rng.choice(["a ", "b ", "c\n", "| ", "\t", "é", "\n\n", "\x0b", "a b c d e "]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows = by_id(quality_rules.statistics(documents(spark, TEXTS + made)))
    for i, text in TEXTS + made:
        assert tuple(rows[i][0][n] for n in NAMES) == brute_statistics(text), text


def test_learned_list(spark):
    rng = random.Random(2)
    good = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(f"{w}{'$$' if i % 4 == 0 else ''}" for w in rng.sample(good, 40))) for i in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    judged, rules = quality_rules.quality_rules(docs, labels)
    assert len(rules.rules) == 1 and rules.rules[0][0].feature == "symbol_share"
    assert {r["doc_id"] for r in judged.filter("kept").collect()} == {i for i, _ in rows if i % 4}
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 300
    assert not quality_rules.quality_rules(docs, labels.limit(0))[1].rules
    assert quality_rules.quality_rules(docs.limit(0), labels)[0].count() == 0
    plan = judged._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_on_hard_rows(spark):
    labels = spark.createDataFrame([(5, 1), (9, 0)], "doc_id bigint, quality int")
    rows = by_id(quality_rules.quality_rules(documents(spark), labels)[0])
    assert len(rows[6]) == 2 and rows[1][0]["base_failed"] and not rows[1][0]["kept"]
    assert rows[5][0]["base_failed"]
