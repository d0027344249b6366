"""Content hashes, fact and resource ids, proquints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.json_values import canonical_json

#: The letters of short ids. The consonants hold a q, unlike the published alphabet, and z is not used.
CONSONANTS, VOWELS = "bdfghjklmnpqrstvz", "aiou"


def content_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def fact_id(relation: Column, args: Column, valid_start: Column, source: Column) -> Column:
    """SHA-256 of relation, canonical arguments, start and source, parted by NUL."""
    parts = [relation, canonical_json(args), valid_start.cast("string"), F.coalesce(source, F.lit(""))]
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def resource_id(root_schema: Column, identity_json: Column, content: Column) -> Column:
    """SHA-256 of the root schema with the identity, or with the content hash where there is none."""
    return F.sha2(F.concat_ws("\0", root_schema, F.coalesce(canonical_json(identity_json), content)), 256)


def _letter(alphabet: str, value: Column, shift: int, mask: int) -> Column:
    index = F.shiftright(value, shift).bitwiseAND(mask).cast("int")
    return F.substring(F.lit(alphabet), index + 1, F.lit(1))


def number_to_proquint(value: Column) -> Column:
    """A 32-bit number as two pronounceable words: consonants of 4 bits and vowels of 2."""
    shape = [(CONSONANTS, 12, 15), (VOWELS, 10, 3), (CONSONANTS, 6, 15), (VOWELS, 4, 3), (CONSONANTS, 0, 15)]
    word = lambda base: F.concat(*(_letter(a, value, base + s, m) for a, s, m in shape))
    return F.concat_ws("-", word(16), word(0))


def proquint(hash_hex: Column) -> Column:
    """The first 32 bits of a hex digest as a proquint."""
    return number_to_proquint(F.conv(F.substring(hash_hex, 1, 8), 16, 10).cast("long"))


def proquint_to_number(text: Column) -> Column:
    """The number of a proquint; null where it is not one."""
    clean = F.lower(F.replace(text, F.lit("-"), F.lit("")))
    shape = [(CONSONANTS, 12), (VOWELS, 10), (CONSONANTS, 6), (VOWELS, 4), (CONSONANTS, 0)]
    total = F.lit(0).cast("long")
    for k in range(10):
        alphabet, shift = shape[k % 5]
        index = F.instr(F.lit(alphabet), F.substring(clean, k + 1, 1)) - 1
        total = total + F.shiftleft(index.cast("long"), shift + (16 if k < 5 else 0))
    return F.when(clean.rlike(f"^([{CONSONANTS}][{VOWELS}][{CONSONANTS}][{VOWELS}][{CONSONANTS}]){{2}}$"), total)
