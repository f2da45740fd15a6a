"""Heuristics on decompiled code; all expressions, no Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of obfuscation
LOOP, SWITCH, CASE = r"(?i)while\s*\(\s*(?:1|true)\s*\)\s*\{", r"switch\s*\(", r"case\s+(?:0x[0-9a-fA-F]+|\d+)\s*:"
OPAQUE = [
    r"\(\s*\w+\s*\*\s*\(\s*\w+\s*[+\-]\s*\d+\s*\)\s*\)\s*%\s*2",
    r"\w+\s*\^\s*\w+\s*\)\s*!=\s*0",
    r"\w+\s*&\s*~\s*\w+",
    r"\w+\s*\|\s*~\s*\w+",
]
SUBSTITUTED = [
    r"\(\s*~\s*\w+\s*&\s*\w+\s*\)\s*\|\s*\(\s*\w+\s*&\s*~\s*\w+\s*\)",
    r"\(\s*\w+\s*\^\s*\w+\s*\)\s*\+\s*2\s*\*\s*\(\s*\w+\s*&\s*\w+\s*\)",
    r"~\s*\w+\s*\+\s*1",
]
XOR_LOOP = r"for\s*\([^)]*\)\s*\{[^}]*\^\s*=\s*(?:0x[0-9a-fA-F]+|\d+)\s*;"
STACK_STRING = r"(?:\w+\[\d+\]\s*=\s*(?:0x[0-9a-fA-F]{2}|'\\.?')\s*;\s*){4,}"
# fixed values: constants that tell algorithms
CRYPTO = {
    "AES S-box": ["0x63", "0x7c", "0x77", "0x7b", "0xf2", "0x6b", "0x6f", "0xc5"],
    "AES inverse S-box": ["0x52", "0x09", "0x6a", "0xd5", "0x30", "0x36", "0xa5", "0x38"],
    "AES round constants": ["0x01", "0x02", "0x04", "0x08", "0x10", "0x20", "0x40", "0x80", "0x1b", "0x36"],
    "RC4 KSA": ["0x100"],
    "SHA-256 initial hash": ["0x6a09e667", "0xbb67ae85", "0x3c6ef372", "0xa54ff53a", "0x510e527f", "0x9b05688c", "0x1f83d9ab", "0x5be0cd19"],
    "SHA-256 round constants": ["0x428a2f98", "0x71374491", "0xb5c0fbcf", "0xe9b5dba5"],
    "MD5 T-values": ["0xd76aa478", "0xe8c7b756", "0x242070db", "0xc1bdceee"],
    "CRC32 polynomial": ["0xedb88320", "0x04c11db7"],
    "TEA delta": ["0x9e3779b9"],
}


def _hits(text: Column, patterns: list[str]) -> Column:
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def obfuscation(text: Column) -> Column:
    """The techniques that a text shows, in a fixed order; null for null."""
    machine = text.rlike(LOOP) & text.rlike(SWITCH)
    cases = F.regexp_count(text, F.lit(CASE))
    lines = F.size(F.split(F.rtrim(text, F.lit("\n")), "\n"))
    # fixed values: the limits of each technique
    flags = {
        "control_flow_flattening": machine & (cases >= 4),
        "bogus_control_flow": _hits(text, OPAQUE) >= 2,
        "instruction_substitution": _hits(text, SUBSTITUTED) >= 2,
        "string_encryption": text.rlike(XOR_LOOP) | text.rlike(STACK_STRING),
        "vm_protection": machine & (cases >= 15) & (lines > 200),
    }
    return F.when(text.isNotNull(), F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])))


def crypto_algorithms(text: Column) -> Column:
    """Names of the algorithms of whose constants the text has two, or one where at most two are known."""
    low = F.lower(text)
    count = lambda consts: sum((low.contains(c).cast("int") for c in consts), F.lit(0))
    return F.when(text.isNotNull(), F.array_compact(F.array(*[F.when(count(c) >= (1 if len(c) <= 2 else 2), F.lit(n)) for n, c in CRYPTO.items()])))


def negative_literals(text: Column) -> Column:
    """`+ -N` written as `- N`, for decimal and hexadecimal numbers."""
    return F.regexp_replace(text, r"\+ -(0x[0-9a-fA-F]+|\d+)", "- $1")


def flow(ref_type: Column) -> Column:
    """fall_through, branch, call, computed or unknown, the first that the name of a flow type tells; null is unknown."""
    has = ref_type.contains
    return (
        F.when(has("FALL_THROUGH"), "fall_through").when(has("CONDITIONAL_JUMP"), "branch").when(has("CALL"), "call").when(has("COMPUTED") | has("INDIRECT"), "computed").otherwise("unknown")
    )


def byte_tokens(text: Column, length: int, start: int, stop: int, pad: int) -> Column:
    """The bytes of a text between a start and a stop id, cut or padded to a length; cutting may drop the stop id."""
    digits = F.hex(F.encode(text, "utf-8"))
    pairs = F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))
    ids = F.concat(F.array(F.lit(start)), F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int")), F.array(F.lit(stop)))
    return F.when(text.isNotNull(), F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length))
