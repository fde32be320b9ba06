"""Pseudonyms for personal numbers and dates by keyed permutations of their formats, in SQL functions only.

Numbers that pass their own check (payment cards: Luhn; IBANs: remainder 97; social security numbers: issued
ranges; IPv4 addresses: octets; dates: the calendar; phone numbers: length) are mapped to another valid one by a
Feistel network over exactly the values of their format: two parts of sizes a and b take turns in adding a keyed
digest of the other one, modulo a or b. Separators, country codes, a card's first digit and the padding of dates
stay. The map is one-to-one and depends on the key and the value alone, so equal values get equal pseudonyms in
all documents and keep their links, without any table of them. Numbers that fail the check are left alone.

E-mail addresses and hexadecimal secrets have no numeric format; they become keyed digests of the same
shape, equal for equal values.

Each text is cut once at the candidates (one pattern) and put together again; nothing is shuffled.

Defined results: NULL text stays NULL with nothing replaced, empty text stays empty; repeated rows, NULL
identifiers and further columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import common

ROUNDS = 8
# Within phone numbers: single separators and brackets. After eight digits a number ends before what is a number of its own.
_JOINT = r"[ ./-]?(?:[()][ ./-]?){0,2}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_OTHER = (r"(?:1[89]|2[01])[0-9]{2}[-/.][01]?[0-9][-/.][0-3]?[0-9](?![0-9])|[0-3]?[0-9][-/.][0-3]?[0-9][-/.](?:1[89]|2[01])[0-9]{2}(?![0-9])"
          rf"|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9])|(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])|[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}(?![0-9])")
_NEXT = (rf"[ /-](?:{_OTHER}"
         r"|[2-6][0-9]{3}[ -]?(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|[0-9]{6}[ -]?[0-9]{5})(?![0-9]))")
# Characters of an IBAN by country; those of other countries may have 15 to 34.
_IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
                 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
                 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
                 31: "MT SC", 33: "RU", 32: "LC"}
# Candidates, most specific first. Repetitions of groups are bounded or possessive: the regular expression engine recurses in others.
# A run is a stretch of groups that may hold cards and IBANs beside other digits and capitals.
_PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])",
    "phone": rf"(?<![0-9A-Za-z+])(?:\+[(]?[0-9](?:{_JOINT}[0-9]){{7}}(?:(?!{_NEXT}){_JOINT}[0-9]){{0,7}}"
             rf"|00[1-9](?:{_JOINT}[0-9]){{7}}(?:(?!{_NEXT}){_JOINT}[0-9]){{0,7}}"
             rf"|\((?!(?:1[5-9]|20)[0-9]{{2}}\))[0-9]{{2,5}}\)(?:(?!{_NEXT})[ ./-]?[0-9]){{5,10}}|[0-9]{{3}}([ .-])[0-9]{{3}}\3[0-9]{{4}}"
             rf"|0[1-9][0-9]{{0,4}}(?!{_NEXT})[ /-][0-9](?:(?!{_NEXT})[ ./-]?[0-9]){{5,9}})(?![0-9A-Za-z])",
    "run": rf"(?<![0-9A-Za-z])(?:[2-6]|[A-Z]{{2}}[0-9]{{2}})(?=(?:[ -]?[A-Z0-9]){{10}})[A-Z0-9]*+(?![a-z@_%+])"
           rf"(?:(?![ -](?:{_OTHER}|[0-9A-F]{{32,64}}(?![A-Za-z0-9])|[A-Z0-9._%+-]++@))[ -][A-Z0-9]++(?![a-z@_%+]))*+",
}
# Phone numbers in what is left of a run.
_LEFT_PHONE = r"(?<![0-9A-Z])(?:00[1-9](?:[ -]?[0-9]){7,14}|0[1-9][0-9]{0,4}[ -][0-9](?:[ -]?[0-9]){5,9})(?![0-9A-Z])"
CANDIDATE = "|".join(_PATTERNS.values())


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` is ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Sql:
    """SQL expressions under one key."""

    def __init__(self, key: str):
        self.key = _quoted(key)

    def digest(self, kind: str, *values: str) -> str:
        return f"sha2(concat_ws('|', {self.key}, '{kind}', {', '.join(values)}), 256)"

    def amount(self, kind: str, step: str, value: str, size: str) -> str:
        """A keyed number below ``size``: 60 bits of the digest."""
        return f"(cast(conv(substr({self.digest(kind, f'cast({step} as string)', f'cast({value} as string)')}, 1, 15), 16, 10) as bigint) % {size})"

    def feistel(self, left: str, right: str, a: str, b: str, kind: str, finish: str) -> str:
        """``finish`` names the permuted parts s.l (below a) and s.r (below b)."""
        return (f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> named_struct("
                f"'l', if(i % 2 = 0, (s.l + {self.amount(kind, 'i', 's.r', a)}) % {a}, s.l), "
                f"'r', if(i % 2 = 1, (s.r + {self.amount(kind, 'i', 's.l', b)}) % {b}, s.r)), s -> {finish})")

    def digits(self, value: str, kind: str) -> str:
        """A string of 1 to 34 digits permuted among all of its length; '' stays."""
        power = "cast(rpad('1', cast({} + 1 as int), '0') as bigint)"
        half, rest = "cast(length(d) - length(d) div 2 as int)", "cast(length(d) div 2 as int)"
        body = self.feistel(f"substr(d, 1, {half})", f"concat('0', substr(d, {half} + 1))", power.format(half), power.format(rest), kind,
                            f"concat(lpad(cast(s.l as string), {half}, '0'), if({rest} = 0, '', lpad(cast(s.r as string), {rest}, '0')))")
        return _let(value, "d", f"if(d = '', '', {body})")

    @staticmethod
    def only_digits(value: str) -> str:
        return f"regexp_replace({value}, '[^0-9]', '')"

    @staticmethod
    def refilled(text: str, digits: str) -> str:
        """``text`` with its digits replaced in order."""
        return (f"aggregate(split({text}, ''), named_struct('o', '', 'p', 1), (z, c) -> named_struct("
                f"'o', concat(z.o, if(c between '0' and '9', substr({digits}, z.p, 1), c)), 'p', z.p + if(c between '0' and '9', 1, 0)), z -> z.o)")

    @staticmethod
    def luhn(payload: str) -> str:
        """Check digit of a string of digits."""
        # counted from the right, every digit at an odd place of the payload is doubled
        total = (f"aggregate(split({payload}, ''), named_struct('t', 0, 'i', length({payload})), (q, c) -> named_struct("
                 f"'t', q.t + if(c = '', 0, if(q.i % 2 = 1, cast(c as int) * 2 - if(c > '4', 9, 0), cast(c as int))), 'i', q.i - if(c = '', 0, 1)), q -> q.t)")
        return f"cast((10 - {total} % 10) % 10 as string)"

    @staticmethod
    def remainder97(value: str) -> str:
        """Remainder of an IBAN-like string by 97: the first four characters move to the end, letters count from 10."""
        return (f"aggregate(split(concat(substr({value}, 5), substr({value}, 1, 4)), ''), cast(0 as bigint), (t, c) -> if(c = '', t, "
                "if(c between '0' and '9', (t * 10 + cast(c as bigint)) % 97, (t * 100 + ascii(c) - 55) % 97)))")

    def card(self) -> str:
        fresh = f"concat(substr(n, 1, 1), {self.digits('substr(n, 2, length(n) - 2)', 'card')})"
        return _let(self.only_digits("m"), "n", _let(fresh, "f", self.refilled("m", f"concat(f, {self.luhn('f')})")))

    def iban(self) -> str:
        body = _let(self.only_digits("substr(n, 5)"), "e", _let(self.digits("e", "iban"), "f", _let(
            self.refilled("substr(n, 5)", "f"), "g", _let(
                f"lpad(cast(98 - {self.remainder97("concat(substr(n, 1, 2), '00', g)")} as string), 2, '0')", "k", self.refilled("m", "concat(k, f)")))))
        return _let("translate(m, ' -', '')", "n", body)

    def run(self) -> str:
        """(t, n): the run with each card and IBAN replaced, and the number of those that changed.

        Readings begin and end at the borders of groups. Of readings that overlap, those of a usual length (the
        country's, the card scheme's; cards in usual groups before others) go first, then the leftmost, then the longest.
        """
        listed = " ".join(f"when substr(x, 1, 2) in ({', '.join(repr(c) for c in codes.split())}) then {n}" for n, codes in _IBAN_LENGTHS.items())
        usual = ("case when x rlike '^4' then length(x) in (13, 16, 19) when x rlike '^3[47]' then length(x) = 15 when x rlike '^3[0689]' then length(x) = 14 "
                 "when x rlike '^6' then length(x) between 16 and 19 else length(x) = 16 end")
        grouped = "^([0-9]{4}[ -]?){3}[0-9]{1,4}[ -]?([0-9]{3}[ -]?)?$|^[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{4,5}[ -]?$"
        good_iban = f"length(x) = coalesce(case {listed} end, length(x)) and {self.remainder97('x')} = 1"
        good_card = f"{self.luhn('substr(x, 1, length(x) - 1)')} = right(x, 1)"
        rank = (f"case when x rlike '^[2-6][0-9]{{12,18}}$' then if({good_card}, if({usual}, if(raw rlike '{grouped}', 0, 1), 2), 3) "
                f"when x rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}$' then if({good_iban}, if(case {listed} end is null, 2, 0), 3) else 3 end")
        one = f"named_struct('rank', {rank}, 'i', ri, 'nj', -rj)"
        reading = _let("array_join(slice(tok, ri, rj - ri + 1), '')", "raw", _let("translate(raw, ' -', '')", "x", one))
        starts = "filter(sequence(1, size(tok)), ri -> tok[ri - 1] rlike '^([2-6]|[A-Z]{2}[0-9]{2})')"
        readings = f"filter(flatten(transform({starts}, ri -> transform(sequence(ri, least(ri + 30, size(tok))), rj -> {reading}))), rr -> rr.rank < 3)"
        chosen = (f"aggregate(array_sort({readings}), cast(array() as array<struct<rank:int,i:int,nj:int>>), "
                  "(ch, rr) -> if(exists(ch, e -> e.i <= -rr.nj and rr.i <= -e.nj), ch, concat(ch, array(rr))))")
        number = _let("regexp_replace(array_join(slice(tok, here.i, 1 - here.nj - here.i), ''), '[ -]$', '')", "m", f"if(m rlike '^[A-Z]', {self.iban()}, {self.card()})")
        changed = _let("array_join(slice(tok, here.i, 1 - here.nj - here.i), '')", "old", _let(
            number, "new", "named_struct('t', concat(new, substr(old, length(new) + 1)), 'n', if(startswith(old, new), 0, 1))"))
        left = _let("array_join(slice(tok, ti, coalesce(array_min(transform(filter(ch, e -> e.i > ti), e -> e.i)), size(tok) + 1) - ti), '')", "rest", self.left_phones())
        part = _let("get(filter(ch, e -> e.i <= ti and ti <= -e.nj), 0)", "here",
                    f"case when here.i = ti then {changed} when here is null and (ti = 1 or exists(ch, e -> -e.nj = ti - 1)) then {left} "
                    "else named_struct('t', '', 'n', 0) end")
        parts = f"transform(sequence(1, size(tok)), ti -> {part})"
        whole = _let(parts, "p", "named_struct('t', array_join(p.t, ''), 'n', aggregate(p.n, 0, (a, b) -> a + b))")
        return _let("regexp_extract_all(m, '[A-Z0-9]+[ -]?', 0)", "tok", _let(
            chosen, "ch", f"if(size(ch) = 0, {_let('m', 'rest', self.left_phones())}, {whole})"))

    def left_phones(self) -> str:
        """(t, n) of ``rest``, a part of a run without cards and IBANs."""
        pattern = _quoted(_LEFT_PHONE)
        fresh = _let(f"regexp_extract_all(rest, {pattern}, 0)", "was", _let(f"transform(was, m -> {self.phone()})", "now", (
            f"named_struct('t', array_join(zip_with(split(rest, {pattern}, -1), now, (ga, ne) -> concat(ga, coalesce(ne, ''))), ''), "
            "'n', aggregate(zip_with(was, now, (a, b) -> if(a = b, 0, 1)), 0, (a, b) -> a + b))")))
        return f"if(rest rlike '(^|[ -])0[0-9]', {fresh}, named_struct('t', rest, 'n', 0))"

    def ssn(self) -> str:
        area, group, serial = "cast(substr(m, 1, 3) as int)", "cast(substr(m, 5, 2) as int)", "cast(substr(m, 8, 4) as int)"
        good = f"({area} between 1 and 899 and {area} != 666 and {group} > 0 and {serial} > 0)"
        back = "s.l div 99 + 1 + if(s.l div 99 + 1 >= 666, 1, 0)"
        out = f"concat(lpad(cast({back} as string), 3, '0'), '-', lpad(cast(s.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(s.r + 1 as string), 4, '0'))"
        left = f"({area} - 1 - if({area} > 666, 1, 0)) * 99 + {group} - 1"
        return f"if({good}, {self.feistel(left, f'{serial} - 1', '88902', '9999', 'ssn', out)}, m)"

    def ip(self) -> str:
        octet = "cast(element_at(o, {}) as int)"
        good = " and ".join(f"{octet.format(k)} < 256" for k in range(1, 5))
        out = "concat_ws('.', cast(s.l div 256 as string), cast(s.l % 256 as string), cast(s.r div 256 as string), cast(s.r % 256 as string))"
        halves = [f"{octet.format(k)} * 256 + {octet.format(k + 1)}" for k in (1, 3)]
        return _let("split(m, '[.]')", "o", f"if({good}, {self.feistel(*halves, '65536', '65536', 'ip', out)}, m)")

    def date(self) -> str:
        """Days of the 400 years from 1800 on, 146097 = 189 * 773. Day before month unless only the other order is a date."""
        def turned(y: int, mo: int, d: int) -> str:
            parts = [f"lpad(element_at(o, {k}), 2, '0')" for k in (mo, d)]
            day = f"to_date(try_to_timestamp(concat(lpad(element_at(o, {y}), 4, '0'), '-', {parts[0]}, '-', {parts[1]}), 'yyyy-MM-dd'))"
            field = {y: "lpad(cast(year(w) as string), 4, '0')"}
            for k, unit in ((mo, "month"), (d, "day")):
                field[k] = f"if(length(element_at(o, {k})) = 2, lpad(cast({unit}(w) as string), 2, '0'), cast({unit}(w) as string))"
            text = f"concat_ws(regexp_extract(m, '[-/.]', 0), {field[1]}, {field[2]}, {field[3]})"
            fresh = self.feistel("v div 773", "v % 773", "189", "773", "date", "date_add(date'1800-01-01', cast(s.l * 773 + s.r as int))")
            return _let(day, "t", _let("datediff(t, date'1800-01-01')", "v", f"if(v between 0 and 146096, {_let(fresh, 'w', text)}, cast(null as string))"))

        first = f"if(length(element_at(o, 1)) = 4, {turned(1, 2, 3)}, coalesce({turned(3, 2, 1)}, {turned(3, 1, 2)}))"
        return _let("split(m, '[-/.]')", "o", f"coalesce({first}, m)")

    def phone(self) -> str:
        """The country code after a plus sign stays; national digits are permuted, the same with and without it."""
        code = ("if(left(m, 1) = '+', substr(n, 1, case when n rlike '^[17]' then 1 "
                "when n rlike '^(2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])' then 2 else 3 end), '')")
        body = self.refilled("m", f"concat(y, {self.digits('substr(n, length(y) + 1)', 'phone')})")
        return _let(self.only_digits("m"), "n", f"if(length(n) between if(left(m, 1) = '0', 9, 8) and if(left(m, 2) = '00', 17, 15), {_let(code, 'y', body)}, m)")

    def email(self) -> str:
        return f"concat('u', substr({self.digest('email', 'lower(m)')}, 1, 12), '@example.org')"

    def secret(self) -> str:
        """Strings of digits alone, or of letters alone, are no secrets."""
        fresh = f"substr({self.digest('secret', 'lower(m)')}, 1, length(m))"
        return f"if(m rlike '[0-9]' and m rlike '[A-Fa-f]', if(m = upper(m), upper({fresh}), {fresh}), m)"

    def pseudonym(self) -> str:
        """(t, n) of candidate m: its pseudonym, or m itself if it fails its check, and the number of replaced values."""
        kinds = [("contains(m, '@')", self.email()), ("m rlike '^([0-9a-f]{32,}|[0-9A-F]{32,})$'", self.secret()),
                 ("m rlike '^([0-9]{1,3}[.]){3}[0-9]{1,3}$'", self.ip()), ("m rlike '^([0-9]{4}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2})[-/.][0-9]{1,4}$'", self.date()),
                 ("m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'", self.ssn()),
                 ("m rlike '^([+(]|00?[1-9][0-9]*[ ./()-]|00[1-9][0-9]+$|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$)'", self.phone())]
        value = "case " + " ".join(f"when {test} then {value}" for test, value in kinds) + " end"
        return _let(value, "new", f"if(new is null, {self.run()}, named_struct('t', new, 'n', if(new = m, 0, 1)))")


def pseudonymise(docs: DataFrame, key: str, text: str = common.TEXT, ident: str = common.ID) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_replaced.

    ``key`` is a secret: whoever knows it can undo the permutations.
    """
    rows = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("content"))
    some = F.coalesce(F.col("content").rlike("[0-9@]"), F.lit(False))
    rows = rows.withColumn("found", F.when(some, F.regexp_extract_all("content", F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("fresh", F.expr(f"transform(found, m -> {_Sql(key).pseudonym()})"))
    gaps = F.split("content", CANDIDATE, -1)
    # Gaps and candidates alternate, with a gap at either end.
    joined = F.array_join(F.zip_with(gaps, F.col("fresh.t"), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    changed = F.aggregate(F.col("fresh.n"), F.lit(0), lambda n, x: n + x)
    return rows.select("doc_id", F.when(F.size("found") > 0, joined).otherwise(F.col("content")).alias("text"), changed.alias("n_replaced"))
