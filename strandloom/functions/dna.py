"""Column functions on bases, sequences, qualities and CIGAR strings. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of A, C, G, T in packed words, bases in a word, and the quality that stands for a missing one.
BASES_PER_WORD = 32
DEFAULT_QUALITY = 30


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_code(base) -> Column:
    """0 to 4 for A, C, G, T or U, N in either case; null for others."""
    b = F.translate(F.upper(_c(base)), "U", "T")
    return F.when(b.isin("A", "C", "G", "T", "N"), F.instr(F.lit("ACGTN"), b) - 1)


def base_index(base) -> Column:
    """0 to 3 for A, C, G, T or U; null for others, N among them."""
    code = base_code(base)
    return F.when(code < 4, code)


def decode_base(code) -> Column:
    return F.substring(F.lit("ACGT"), (_c(code) + 1).cast("int"), F.lit(1))


def symbol_order(symbol) -> Column:
    """The order of the index: $ 0, A 1, C 2, G 3, T 4, N 5."""
    return F.when(_c(symbol) == "$", F.lit(0)).otherwise(base_code(symbol) + 1)


def sanitized(seq) -> Column:
    """Upper case, U as T; fails where a symbol is none of A, C, G, T, U, N."""
    s = F.translate(F.upper(_c(seq)), "U", "T")
    message = F.concat(F.lit("invalid reference symbol at position "), F.length(F.regexp_extract(s, "^[ACGTN]*", 0)).cast("string"))
    return F.when(s.rlike("^[ACGTN]*$"), s).otherwise(F.raise_error(message))


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(_c(seq), "ACGTacgtUu", "TGCAtgcaAa"))


def pack(seq) -> Column:
    """struct(words, len, nmask): 32 bases in each 64-bit word from the low bits up, and a bit for each N.

    Fails at a symbol that is none of A, C, G, T, U, N. N is packed as 0; null stays null.
    """
    def packed(s):
        ok = s.rlike("^[ACGTN]*$")
        message = F.concat(F.lit("invalid base at position "), F.length(F.regexp_extract(s, "^[ACGTN]*", 0)).cast("string"))
        checked = F.when(ok | s.isNull(), s).otherwise(F.raise_error(message))
        return F.when(s.isNotNull(), F.struct(_words(F.translate(checked, "ACGTN", "01230"), 2).alias("words"), F.length(s).alias("len"), _words(F.translate(checked, "ACGTN", "00001"), 1).alias("nmask")))

    return _bound(F.translate(F.upper(_c(seq)), "U", "T"), packed)


def _bound(value, f) -> Column:
    """f of a value that has a name, so that it isn't written out, and found, again for each of its uses."""
    return F.transform(F.array(value), f)[0]


def _words(digits, bits: int) -> Column:
    """Digits of so many bits as 64-bit words, the first digit lowest. A half word at a time goes through conv, as a whole one may exceed what it holds."""
    half, base = 32 // bits, 1 << bits

    def words(d):
        part = lambda at: F.coalesce(F.conv(F.reverse(F.substring(d, (at + 1).cast("int"), F.lit(half))), base, 10).cast("long"), F.lit(0).cast("long"))
        word = lambda k: part(k * 2 * half).bitwiseOR(F.call_function("shiftleft", part(k * 2 * half + half), F.lit(32)))
        count = F.ceil(F.length(d) / (2 * half)).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), word)).when(count == 0, F.array().cast("array<bigint>"))

    return _bound(digits, words)


def _digits(words, bits: int) -> Column:
    """The digits of words, the inverse of _words; the last word's are filled up."""
    half, base = 32 // bits, 1 << bits
    part = lambda x: F.reverse(F.lpad(F.conv(x.cast("string"), 10, base), half, "0"))
    return F.array_join(F.transform(words, lambda w: F.concat(part(w.bitwiseAND((1 << 32) - 1)), part(F.call_function("shiftrightunsigned", w, F.lit(32))))), "")


def from_parts(words, length, nmask) -> Column:
    """A packed sequence of its parts; fails where the words can't hold so many bases."""
    w, n = _c(words), _c(length).cast("int")
    message = F.concat(F.lit("length "), n.cast("string"), F.lit(" exceeds the capacity of "), F.size(w).cast("string"), F.lit(" words"))
    return F.struct(w.alias("words"), F.when(n.isNull() | (n <= F.size(w) * BASES_PER_WORD), n).otherwise(F.raise_error(message)).alias("len"), _c(nmask).alias("nmask"))


def extend(packed, seq) -> Column:
    """A packed sequence with further bases behind it, by packing all of them anew; fails like pack, at the place in the whole. One base is a push."""
    return _bound(_c(packed), lambda p: pack(F.concat(unpack(p), _c(seq))))


def packed_base(packed, index) -> Column:
    """The base at an index, from 0; null beyond the end."""
    p, i = _c(packed), _c(index)
    code = F.call_function("shiftrightunsigned", p["words"][F.floor(i / 32).cast("int")], ((i % 32) * 2).cast("int")).bitwiseAND(3)
    masked = F.call_function("shiftrightunsigned", p["nmask"][F.floor(i / 64).cast("int")], (i % 64).cast("int")).bitwiseAND(1)
    return F.when((i >= 0) & (i < p["len"]), F.when(masked == 1, F.lit("N")).otherwise(decode_base(code)))


def unpack(packed) -> Column:
    def text(p):
        bases = F.substring(F.translate(_digits(p["words"], 2), "0123", "ACGT"), F.lit(1), p["len"])
        masked = lambda m: F.array_join(F.zip_with(F.split(bases, ""), F.split(F.substring(_digits(m, 1), F.lit(1), p["len"]), ""), lambda b, n: F.when(n == "1", F.lit("N")).otherwise(b)), "")
        return F.when(p["len"] > 0, F.when(F.exists(p["nmask"], lambda w: w != 0), masked(p["nmask"])).otherwise(bases)).when(p["len"] == 0, F.lit(""))

    return _bound(_c(packed), text)


def phred(qual) -> Column:
    """Qualities of a text: each byte less 33, at least 0."""
    q = _c(qual)
    return F.when(q == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(q, ""), lambda c: F.greatest(F.ascii(c) - 33, F.lit(0))))


def mapq_of(mismatches) -> Column:
    m = _c(mismatches)
    return F.when(m == 0, 60).when(m == 1, 40).when(m == 2, 20).otherwise(0)


def cigar_operations(cigar) -> Column:
    """array<struct<op, len>> of M, I, D, S, H."""
    found = F.regexp_extract_all(_c(cigar), F.lit("([0-9]+)([MIDSH])"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, "^[0-9]+", 0).cast("int").alias("len")))


def match_cigar(cigar, read_length) -> Column:
    """The operations of a CIGAR that is one match as long as the read; anything else fails."""
    c, n = _c(cigar), _c(read_length)
    ok = c.rlike("^[0-9]+M$") & (F.regexp_extract(c, "^([0-9]+)M$", 1).cast("int") == n)
    return F.when(ok, cigar_operations(c)).otherwise(F.raise_error(F.concat(F.lit("unsupported CIGAR "), F.coalesce(c, F.lit("null")))))
