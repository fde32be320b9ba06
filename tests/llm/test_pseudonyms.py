import re

from netloom.llm import pseudonyms

from .conftest import AWKWARD


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(text):
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


VALUES = {
    "4111 1111 1111 1111": lambda v: re.fullmatch(r"4\d{3}( \d{4}){3}", v) and _luhn(v.replace(" ", "")),
    "5500005555555559": lambda v: re.fullmatch(r"5\d{15}", v) and _luhn(v),
    "378282246310005": lambda v: re.fullmatch(r"3\d{14}", v) and _luhn(v),
    "DE89 3704 0044 0532 0130 00": lambda v: re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", v) and _iban(v),
    "GB29NWBK60161331926819": lambda v: re.fullmatch(r"GB\d\dNWBK\d{14}", v) and _iban(v),
    "192.168.0.17": lambda v: re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", v) and max(map(int, v.split("."))) < 256,
    "1987-03-25": lambda v: re.fullmatch(r"(18|19|20|21)\d\d-\d\d-\d\d", v),
    "3.7.1999": lambda v: re.fullmatch(r"\d{1,2}\.\d{1,2}\.\d{4}", v),
    "12/31/2001": lambda v: re.fullmatch(r"\d\d/\d\d/\d{4}", v) and int(v[:2]) <= 12,
    "078-05-1120": lambda v: re.fullmatch(r"\d{3}-\d{2}-\d{4}", v) and v[:3] not in ("000", "666") and v[:3] < "900",
    "+1 (389) 555-5010": lambda v: re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", v),
    "+49 30 1234567": lambda v: v == "+49 30 1234567" or re.fullmatch(r"\+49 \d\d \d{7}", v),
    "389-555-5010": lambda v: re.fullmatch(r"\d{3}-\d{3}-\d{4}", v),
    "orpc.76@mail3.example.com": lambda v: re.fullmatch(r"u[0-9a-f]{12}@example\.org", v),
    "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde": lambda v: re.fullmatch(r"[0-9a-f]{40}", v),
}
LEFT = ["4111111111111112", "9807915762804490", "999.1.1.1", "2001-02-30", "000-12-3456", "version 3.11", "5/10", "1234567", "DE89370400440532013001", "a.b", "x@y", "2 0 0 1"]


def test_pseudonyms_keep_their_format(spark):
    text = "; ".join(VALUES)
    rows = [(1, text, "x"), (2, "again: " + text + "!", "x"), (3, "; ".join(LEFT), "x")]
    found = {r["doc_id"]: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, found string"), "k1").collect()}
    new = found[1]["text"].split("; ")
    for (old, good), value in zip(VALUES.items(), new, strict=True):
        assert good(value), (old, value)
        assert value != old or old.startswith("+49")
    assert found[2]["text"] == "again: " + found[1]["text"] + "!"  # equal values stay linked
    assert (found[3]["text"], found[3]["n_replaced"]) == ("; ".join(LEFT), 0)
    phone = dict(zip(VALUES, new, strict=True))
    assert re.sub(r"\D", "", phone["+1 (389) 555-5010"])[1:] == re.sub(r"\D", "", phone["389-555-5010"])
    other = pseudonyms.pseudonymise(spark.createDataFrame(rows[:1], "doc_id long, text string, found string"), "k2").first()["text"].split("; ")
    assert sum(a != b for a, b in zip(new, other, strict=True)) >= len(VALUES) - 1


def test_maps_are_one_to_one(spark):
    ips = [f"10.0.{i // 256}.{i % 256}" for i in range(600)]
    days = [f"2024-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)]
    ssns = [f"665-99-{i:04d}" for i in range(9700, 10000)] + [f"667-01-{i:04d}" for i in range(1, 300)]
    rows = [(i, v) for i, v in enumerate(ips + days + ssns)]
    new = [r["text"] for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    assert len(set(new)) == len(rows)


def test_awkward_rows(docs):
    found = sorted(((str(r["doc_id"]), r["text"], r["n_replaced"]) for r in pseudonyms.pseudonymise(docs(AWKWARD), "k").collect()), key=str)
    assert found == sorted(((str(i), t, 0) for i, t in AWKWARD), key=str)
    assert pseudonyms.pseudonymise(docs([]), "k").count() == 0
    long_text = "call +1 (389) 555-5010 or a.b@c.de; " * 20_000
    assert pseudonyms.pseudonymise(docs([(1, long_text)]), "k").first()["n_replaced"] == 40_000


def test_no_python_in_the_plan(docs):
    plan = pseudonyms.pseudonymise(docs(AWKWARD), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


PHONES = ["+14155552671", "+33 6 12 34 56 78", "+49 30 1234567", "+49 (0)30/1234567", "415 555 2671", "(030) 1234567", "(415) 555-2671", "(02) 9876 5432", "030 1234567",
          "06 12 34 56 78", "0049 30 1234567", "0044 (0)20 7946 0958", "+1 (389) 555-5010"]


def test_phone_numbers_of_every_shape(docs):
    rows = [(k, v) for k, v in enumerate(PHONES)] + [(100, f"call {', '.join(PHONES)} now")]
    found = {r["doc_id"]: r for r in pseudonyms.pseudonymise(docs(rows), "k1").collect()}
    new = [found[k]["text"] for k in range(len(PHONES))]
    for old, value in zip(PHONES, new, strict=True):
        assert value != old and re.sub(r"\d", "0", value) == re.sub(r"\d", "0", old), (old, value)
    assert (found[100]["text"], found[100]["n_replaced"]) == (f"call {', '.join(new)} now", len(PHONES))
    assert [v[:3] for v in new[:4]] == ["+1" + new[0][2], "+33", "+49", "+49"]  # country codes stay
    # the same number in other shapes
    digits = {old: re.sub(r"\D", "", v) for old, v in zip(PHONES, new, strict=True)}
    assert digits["+14155552671"][1:] == digits["415 555 2671"] == digits["(415) 555-2671"]


def test_phone_numbers_end_before_other_numbers(docs):
    others = ["4111 1111 1111 1111", "078-05-1120", "1987-03-25", "192.168.0.17", "389 555 5010"]
    rows = [(k, f"+49 30 1234567 {v}") for k, v in enumerate(others)] + [(10 + k, v) for k, v in enumerate(others)] + [(20, "+49 30 1234567")]
    rows += [(30, "(1998) 123-145; +1234; 12 34 56; 1 234 567; 01-32-2003")]
    found = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(docs(rows), "k1").collect()}
    for k in range(len(others)):
        assert found[k] == f"{found[20]} {found[10 + k]}"
    assert found[30] == rows[-1][1]


CARD, IBAN = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
BESIDE = ["{} 123", "{} 12/27", "17 {}", "17-{}", "{} EUR 500", "{} 2024", "EUR 500 {} VISA 12", "AB12 {} 99", "20 71 72 73 74 75 76 79 78 81 82 83 84 85 86 87 88 89 91 {} 25", "5 123 {}"]
NEIGHBOURS = ["2024-01-05", "192.168.0.17", "078-05-1120", "415 555 2671", "JOE.X@mail.example.com", "GB29NWBK60161331926819", "5500005555555559", "378282246310005"]


def test_cards_and_ibans_beside_other_numbers(docs):
    values = [CARD, IBAN, CARD.replace(" ", ""), IBAN.replace(" ", "")]
    rows = [(k, v) for k, v in enumerate(values + NEIGHBOURS)]
    rows += [(1000 + 100 * i + k, shape.format(v)) for i, v in enumerate(values) for k, shape in enumerate(BESIDE)]
    rows += [(2000 + 100 * i + k, f"{v} {n}") for i, v in enumerate(values) for k, n in enumerate(NEIGHBOURS)]
    rows += [(3000, f"{CARD} {IBAN} {CARD}"), (3001, "12 " * 20_000 + CARD), (3002, "A1 " * 20_000 + IBAN + " 7B" * 20_000)]
    found = {r["doc_id"]: r for r in pseudonyms.pseudonymise(docs(rows), "k1").collect()}
    new = [found[k]["text"] for k in range(len(values))]
    assert all(a != b for a, b in zip(values, new, strict=True))
    for i in range(len(values)):
        for k, shape in enumerate(BESIDE):
            assert (found[1000 + 100 * i + k]["text"], found[1000 + 100 * i + k]["n_replaced"]) == (shape.format(new[i]), 1)
        for k in range(len(NEIGHBOURS)):
            assert (found[2000 + 100 * i + k]["text"], found[2000 + 100 * i + k]["n_replaced"]) == (f"{new[i]} {found[len(values) + k]['text']}", 2)
    assert (found[3000]["text"], found[3000]["n_replaced"]) == (f"{new[0]} {new[1]} {new[0]}", 3)
    assert found[3001]["text"] == "12 " * 20_000 + new[0]
    assert found[3002]["text"] == "A1 " * 20_000 + new[1] + " 7B" * 20_000


def test_phone_numbers_in_what_is_left_of_a_run(docs):
    phones = ["030 1234567", "06 12 34 56 78", "0049 30 1234567"]
    rows = [(k, v) for k, v in enumerate([*phones, CARD])]
    rows += [(10 + k, f"2024 {v}") for k, v in enumerate(phones)] + [(20 + k, f"{CARD} {v} EUR 5") for k, v in enumerate(phones)]
    found = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pseudonyms.pseudonymise(docs(rows), "k1").collect()}
    for k in range(len(phones)):
        assert found[10 + k] == (f"2024 {found[k][0]}", 1)
        assert found[20 + k] == (f"{found[3][0]} {found[k][0]} EUR 5", 2)
