"""Format-preserving pseudonyms for personal data, in SQL functions only.

Numbers and dates that pass their format's validation are permuted, under a key, within that format by a Feistel network: card numbers
keep their length, spacing and check digit rule, IBANs their country, letters and check digits, addresses of IPv4, social security
numbers and dates stay valid ones, phone numbers keep their country code and punctuation. A permutation maps equal values to
equal pseudonyms and different values to different ones, in every document and table that uses the key. E-mail
addresses, which aren't numbers, become keyed names under a reserved domain. What fails validation stays as it is, but not the values
inside it: of each place, from left to right, the longest valid candidate counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

_B, _E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: The shapes of each kind, tried in this order; validation follows.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}" + _E,
    "iban": _B + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _E,
    "date": _B + r"(?:(?:19|20)[0-9]{2}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./])[0-9]{2}\2(?:19|20)[0-9]{2})" + _E,
    "ip": r"(?<![0-9A-Za-z.])" + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + r"(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?:(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?|(?<![0-9A-Za-z+]))\(?[0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}" + _E + r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}" + _E + "|" + _B + "[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}" + _E,
    "ssn": _B + "[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E,
    "card": _B + "[0-9](?:[ -]?[0-9]){12,18}" + _E,
}
#: What parts no value and touches none, so that a text may be cut behind it.
_CUT = r"(?<=[\n\t,;:!?|=<>])|(?<=[a-z ] )"
#: Characters of a whole IBAN by country.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()
}
#: Fixed value: the calling codes of one and two digits; all others have three.
COUNTRY_CODE = "^(1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|[0-9]{3})"
#: An even number of rounds, so that both halves change equally often.
ROUNDS = 10


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _round(key: str, kind: str, value: str, below: str) -> str:
    """A keyed function of the round i and one half, below a bound of at most 10^15."""
    inner = f"sha2(concat({_quoted(key)}, '|{kind}|', i, '|', {below}, '|', {value}), 256)"
    return f"pmod(CAST(conv(substr(sha2(concat({_quoted(key)}, {inner}), 256), 1, 15), 16, 10) AS BIGINT), {below})"


def feistel(left: str, right: str, a: str, b: str, key: str, kind: str) -> str:
    """SQL for struct(l, r): a keyed permutation of the pairs 0 <= l < a, 0 <= r < b; in turn, each half is shifted by a function of the other."""
    one = f"named_struct('l', (s.l + {_round(key, kind, 's.r', a)}) % {a}, 'r', s.r)"
    two = f"named_struct('l', s.l, 'r', (s.r + {_round(key, kind, 's.l', b)}) % {b})"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT)), (s, i) -> IF(i % 2 = 1, {one}, {two}))"


def _with(value: str, name: str, body: str) -> str:
    """SQL for body with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digits(d: str, key: str, kind: str) -> str:
    """SQL for a permutation of the digit strings of one length, 2 to 30."""
    h = f"(length({d}) DIV 2)"
    power = "CAST(rpad('1', {} + 1, '0') AS BIGINT)"
    a, b = power.format(h), power.format(f"(length({d}) - {h})")
    made = feistel(f"substr({d}, 1, {h})", f"substr({d}, {h} + 1)", a, b, key, kind)
    return _with(made, "v", f"concat(lpad(CAST(v.l AS STRING), {h}, '0'), lpad(CAST(v.r AS STRING), length({d}) - {h}, '0'))")


def refilled(shape: str, new: str) -> str:
    """SQL for a text whose digits are replaced, one after the other, by those of a string."""
    step = "IF(c BETWEEN '0' AND '9', named_struct('o', concat(s.o, substr({0}, s.i, 1)), 'i', s.i + 1), named_struct('o', concat(s.o, c), 'i', s.i))".format(new)
    return f"aggregate(split({shape}, ''), named_struct('o', '', 'i', 1), (s, c) -> {step}, s -> s.o)"


def luhn(d: str) -> str:
    """SQL for the sum of a digit string by the rule of card numbers; a whole number is valid where it is divisible by 10."""
    one = f"CAST(substr({d}, length({d}) - i, 1) AS INT)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (s, i) -> s + IF(i % 2 = 0, {one}, 2 * {one} - IF({one} > 4, 9, 0)))"


def mod97(x: str) -> str:
    """SQL for an alphanumeric string, letters as 10 to 35, modulo 97."""
    return f"aggregate(split({x}, ''), 0, (s, c) -> IF(c BETWEEN '0' AND '9', s * 10 + CAST(c AS INT), s * 100 + ascii(c) - 55) % 97)"


def _email(m: str, key: str) -> str:
    return f"concat('user-', substr(sha2(concat({_quoted(key)}, sha2(concat({_quoted(key)}, '|email|', lower({m})), 256)), 256), 1, 16), '@example.invalid')"


def _card(m: str, key: str) -> str:
    own = digits("substr(d, 1, length(d) - 1)", key, "card")
    new = _with(own, "p", f"concat(p, CAST((10 - {luhn("concat(p, '0')")} % 10) % 10 AS STRING))")
    return _with(f"regexp_replace({m}, '[^0-9]', '')", "d", f"IF({luhn('d')} % 10 = 0, {_with(new, 'n', refilled(m, 'n'))}, {m})")


def _iban(m: str, key: str) -> str:
    """The digits behind the check digits are permuted, the letters stay; the check digits follow from the result."""
    old = "regexp_replace(substr(d, 5), '[^0-9]', '')"
    body = _with(old, "q", f"IF(length(q) < 2, substr(d, 5), {_with(digits('q', key, 'iban'), 'n', refilled('substr(d, 5)', 'n'))})")
    check = mod97("concat(w, substr(d, 1, 2), '00')")
    whole = _with(body, "w", f"concat(substr(d, 1, 2), lpad(CAST(98 - {check} AS STRING), 2, '0'), w)")
    spaced = f"aggregate(split({m}, ''), named_struct('o', '', 'i', 1), (s, c) -> IF(c = ' ', named_struct('o', concat(s.o, c), 'i', s.i), named_struct('o', concat(s.o, substr(n, s.i, 1)), 'i', s.i + 1)), s -> s.o)"
    valid = mod97("concat(substr(d, 5), substr(d, 1, 4))")
    return _with(f"replace({m}, ' ', '')", "d", f"IF(length(d) BETWEEN 15 AND 34 AND {valid} = 1, {_with(whole, 'n', spaced)}, {m})")


def _ip(m: str, key: str) -> str:
    part = [f"CAST(split({m}, '[.]')[{k}] AS BIGINT)" for k in range(4)]
    made = feistel(f"{part[0]} * 256 + {part[1]}", f"{part[2]} * 256 + {part[3]}", "65536L", "65536L", key, "ip")
    return _with(made, "v", "concat_ws('.', v.l DIV 256, v.l % 256, v.r DIV 256, v.r % 256)")


def _ssn(m: str, key: str) -> str:
    """Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999."""
    area, group, serial = (f"CAST(split({m}, '-')[{k}] AS BIGINT)" for k in range(3))
    made = feistel(f"({area} - IF({area} > 666, 2, 1)) * 99 + {group} - 1", f"{serial} - 1", "88902L", "9999L", key, "ssn")
    new = "concat_ws('-', lpad(CAST(v.l DIV 99 + IF(v.l DIV 99 >= 665, 2, 1) AS STRING), 3, '0'), lpad(CAST(v.l % 99 + 1 AS STRING), 2, '0'), lpad(CAST(v.r + 1 AS STRING), 4, '0'))"
    return f"IF({area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0, {_with(made, 'v', new)}, {m})"


def _date(m: str, key: str) -> str:
    """The 73,049 = 17 * 4,297 days of 1900 to 2099."""
    iso = f"({m} RLIKE '^[0-9]{{4}}')"
    gap = f"substr({m}, IF({iso}, 5, 3), 1)"
    plain = f"IF({iso}, concat(substr({m}, 1, 4), '-', substr({m}, 6, 2), '-', substr({m}, 9, 2)), concat(substr({m}, 7, 4), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2)))"
    number = f"CAST(datediff(try_cast({plain} AS DATE), DATE '1900-01-01') AS BIGINT)"
    made = _with(feistel("k DIV 4297", "k % 4297", "17L", "4297L", key, "date"), "v", "date_add(DATE '1900-01-01', CAST(v.l * 4297 + v.r AS INT))")
    shown = _with(made, "t", f"IF({iso}, concat(date_format(t, 'yyyy'), {gap}, date_format(t, 'MM'), {gap}, date_format(t, 'dd')), concat(date_format(t, 'dd'), {gap}, date_format(t, 'MM'), {gap}, date_format(t, 'yyyy')))")
    return _with(number, "k", f"IF(k IS NULL, {m}, {shown})")


def _phone(m: str, key: str) -> str:
    """After a plus the country code stays, whatever separates it, and the national number is permuted; without one, all digits are that number."""
    new = _with(digits("substr(d, length(code) + 1)", key, "phone"), "n", refilled(m, "concat(code, n)"))
    body = _with(f"IF(left({m}, 1) = '+', regexp_extract(d, '{COUNTRY_CODE}', 0), '')", "code", f"IF(length(d) BETWEEN 7 AND 15 AND length(d) - length(code) >= 6, {new}, {m})")
    return _with(f"regexp_replace({m}, '[^0-9]', '')", "d", body)


def pseudonym(m: str, key: str) -> str:
    """SQL for the pseudonym of one match of any kind, or the match itself where it isn't valid."""
    make = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}
    cases = " ".join(f"WHEN {m} RLIKE {_quoted('^(?:' + KINDS[k] + ')$')} THEN {make[k](m, key)}" for k in KINDS)
    return f"CASE {cases} ELSE {m} END"


def _shapes() -> str:
    """All kinds in one pattern; only dates have groups, so their back references hold there too."""
    return "|".join(KINDS.values())


def pseudonymised(text: str, key: str) -> tuple[Column, Column]:
    """The text with pseudonyms, and how many values were replaced. The matches and what lies between them come from one pattern."""
    found = f"IF({text} RLIKE '[0-9@]', regexp_extract_all({text}, {_quoted(_shapes())}, 0), array())"
    between = f"split({text}, {_quoted(_shapes())}, -1)"
    both = f"transform({found}, m -> named_struct('old', m, 'new', {pseudonym('m', key)}))"
    return F.expr(both), F.expr(between)


def _longest_valid(m: str, key: str) -> str:
    """SQL for struct(n, new) of the longest valid candidate that begins where a match does and ends where a word of it does; null if there is none."""
    lengths = "map(" + ", ".join(f"'{k}', {n}" for k, n in IBAN_LENGTHS.items()) + ")"
    whole = f"(l = length({m}) OR x NOT RLIKE '^[A-Z]' OR coalesce({lengths}[substr(x, 1, 2)] = length(replace(x, ' ', '')), true))"
    one = _with(f"substr({m}, 1, l)", "x", f"IF({whole}, {_with(pseudonym('x', key), 'y', "IF(y <> x, named_struct('n', l, 'new', y), NULL)")}, NULL)")
    ends = f"substr({m}, l + 1, 1) RLIKE '[0-9A-Za-z]'"
    return f"aggregate(sequence(length({m}), 1, -1), CAST(NULL AS STRUCT<n: INT, new: STRING>), (s, l) -> IF(s IS NOT NULL OR {ends}, s, {one}))"


def _again(part: str, key: str) -> str:
    """SQL for struct(o, n, skip): a text with pseudonyms and their number, found from each place at which any shape begins, not only behind the last match."""
    at = f"(?=({_shapes().replace(chr(92) + '2', chr(92) + '3').replace(chr(92) + '1', chr(92) + '2')}))"  # the new group moves the back references
    found = f"transform(regexp_extract_all({part}, {_quoted(at)}, 1), m -> {_longest_valid('m', key)})"
    # the first piece is what stands before the first place, unless that is the beginning
    pieces = _with(f"split({part}, {_quoted(at)}, -1)", "p", "IF(size(p) = size(f), p, slice(p, 2, size(f)))")
    first = f"IF(size(f) = 0, {part}, substr({part}, 1, length({part}) - aggregate(p, 0, (s, x) -> s + length(x))))"
    rest = "named_struct('o', concat(s.o, substr(x.p, s.skip + 1)), 'n', s.n, 'skip', greatest(s.skip - length(x.p), 0))"
    new = "named_struct('o', concat(s.o, x.f.new, substr(x.p, x.f.n + 1)), 'n', s.n + 1, 'skip', greatest(x.f.n - length(x.p), 0))"
    fold = f"aggregate(zip_with(p, f, (p, f) -> named_struct('p', p, 'f', f)), named_struct('o', {first}, 'n', 0, 'skip', 0), (s, x) -> IF(s.skip > 0 OR x.f IS NULL, {rest}, {new}))"
    return _with(found, "f", _with(pieces, "p", fold))


def mask(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with pseudonyms in place of valid personal data; all other columns stay, and count_col, if named, is added.

    A text whose every match is valid is done at once. Where one fails, the text is searched again from each place: a shorter candidate
    there, or one that begins inside or reaches beyond what failed, may be valid.

    Null texts stay null (count 0), texts without matches are returned as they are; each row is treated by itself, so copies get equal
    results and nothing is shuffled. The key is a secret of the caller: with another key, all pseudonyms differ.
    """
    if not key:
        raise ValueError("a key is needed")
    found_in, again_in = free_names(docs, "pii_found", "pii_again")
    found, between = pseudonymised(f"`{text_col}`", key)
    out = docs.withColumn(found_in, F.coalesce(found, F.expr("array()")))
    parts = f"transform(split(`{text_col}`, {_quoted(_CUT)}, -1), t -> IF(t RLIKE '[0-9@]', {_again('t', key)}, named_struct('o', t, 'n', 0, 'skip', 0)))"
    out = out.withColumn(again_in, F.expr(f"IF(exists(`{found_in}`, x -> x.old = x.new), {parts}, NULL)"))
    new = F.expr(f"transform(`{found_in}`, x -> x.new)")
    pieces = F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda p, n: F.concat(p, n))
    again = F.col(again_in).isNotNull()
    text = F.when(again, F.expr(f"array_join(transform(`{again_in}`, x -> x.o), '')")).when(F.size(found_in) > 0, F.array_join(pieces, ""))
    out = out.withColumn(text_col, text.otherwise(F.col(text_col)))
    if count_col:
        out = out.withColumn(count_col, F.expr(f"CAST(IF(`{again_in}` IS NOT NULL, aggregate(`{again_in}`, 0, (s, x) -> s + x.n), size(filter(`{found_in}`, x -> x.old <> x.new))) AS BIGINT)"))
    return out.drop(found_in, again_in)
