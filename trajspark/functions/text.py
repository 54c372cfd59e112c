"""Text and naming functions as native expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_language(t: Column) -> Column:
    """Lower case without anything but letters, digits, underscores and white space (of any script)."""
    return F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]", "")


#: Rounds of the hash: shift, odd multiplier below 2^31 (so that no product leaves 63 bits).
ROUNDS = ((16, 0x21F0AAAD), (15, 0x735A2D97))


def mixed(x: int) -> int:
    """The hash's mixing of one 32-bit number: shift-xor, multiply, and a last shift-xor."""
    for shift, factor in ROUNDS:
        x = (x ^ x >> shift) * factor % (1 << 32)
    return x ^ x >> 15


def portable_hash(x: Column, seed: int = 0) -> Column:
    """A seeded 32-bit hash of an integer of at least 0, in integer steps that any engine can compute.

    The number, folded to 32 bits, is mixed, met with the mixed seed, and mixed again, so that another
    seed gives another order, not a shifted one.
    """
    h = x.cast("bigint")
    h = h.bitwiseAND(F.lit((1 << 32) - 1)).bitwiseXOR(F.shiftright(h, 32))
    for last in (False, True):
        for shift, factor in ROUNDS:
            h = h.bitwiseXOR(F.shiftright(h, shift)) * F.lit(factor) % F.lit(1 << 32)
        h = h.bitwiseXOR(F.shiftright(h, 15))
        if not last:
            h = h.bitwiseXOR(F.lit(mixed(seed % (1 << 32))))
    return h


def hash_sql(x: str, seed: int = 0) -> str:
    """portable_hash as SQL over the expression `x`."""
    h = f"xor(({x})::bigint & 4294967295, ({x})::bigint >> 32)"
    for last in (False, True):
        for shift, factor in ROUNDS:
            h = f"(list_transform([{h}], lambda q: xor(q, q >> {shift}) * {factor} % 4294967296)[1])"
        h = f"(list_transform([{h}], lambda q: xor(q, q >> 15))[1])"
        if not last:
            h = f"xor({h}, {mixed(seed % (1 << 32))}::bigint)"
    return h


def pick_one(xs: Column, key: Column, seed: int = 0) -> Column:
    """One element of an array by a seeded hash of `key`; null for an empty array."""
    return F.when(F.size(xs) > 0, F.element_at(xs, (portable_hash(key, seed) % F.size(xs) + 1).cast("int")))


def annotation_key(name: Column) -> Column:
    return F.replace(name, F.lit("annotation."), F.lit(""))


def resolve_tag(text: Column, tags: dict[str, str]) -> Column:
    """A tag's value from its name or value, trimmed and in any case; names go first; null if unknown."""
    plain = F.lower(F.trim(text))
    by_name = F.create_map(*[F.lit(x) for k, v in tags.items() for x in (k.lower(), v)])
    by_value = F.create_map(*[F.lit(x) for v in tags.values() for x in (v.lower(), v)])
    return F.coalesce(by_name[plain], by_value[plain])


def tag_of_environment(env: Column, tags: dict[str, str], default: str) -> Column:
    """The tag of the part of an environment's name before the first slash."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])[F.split_part(env, F.lit("/"), F.lit(1))], F.lit(default))


def chat_message(text: Column, images: int) -> Column:
    """One user message: the images by number, then the text."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))
    return F.struct(F.lit("user").alias("role"), F.array(*[part("image", F.lit(i)) for i in range(images)], part("text", text)).alias("content"))


def strip_prefix(m: Column, prefix: str) -> Column:
    """Map keys without a leading prefix."""
    return F.transform_keys(m, lambda k, _: F.when(k.startswith(prefix), F.substr(k, F.lit(len(prefix) + 1))).otherwise(k))


def add_prefix(m: Column, prefix: str) -> Column:
    return F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix), k))


def fraction(text: Column) -> Column:
    """A number written as a/b or plainly; null for a zero denominator."""
    a, b = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
    return F.when(b == "", a.try_cast("double")).when(b.try_cast("double") != 0, a.try_cast("double") / b.try_cast("double"))


def step_of_checkpoint(path: Column) -> Column:
    """The number of a path's checkpoint-N part, null if it has none."""
    return F.regexp_extract(path, r"checkpoint-(\d+)", 1).try_cast("int")


def canonical_name(spec: Column) -> Column:
    """A package's name: lower case, runs of - _ . as one -."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(spec), r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)), r"[-_.]+", "-")


def requirement(line: Column) -> Column:
    """A dependency line as (name, spec, marker): the canonical name, version specifications without white space, and what follows a ;.

    Comments are cut off; extras in brackets are left out; parts that aren't there are ''.
    """
    plain = F.trim(F.regexp_replace(line, r"(^|\s)#.*$", ""))
    body, marker = F.trim(F.split_part(plain, F.lit(";"), F.lit(1))), F.trim(F.regexp_extract(plain, r";(.*)$", 1))
    spec = F.regexp_replace(F.regexp_replace(body, r"^[A-Za-z0-9][A-Za-z0-9._-]*\s*(\[[^\]]*\])?", ""), r"[\s()]", "")
    return F.struct(canonical_name(body).alias("name"), spec.alias("spec"), marker.alias("marker"))


#: Kinds of messages to a processor.
MESSAGES = ("start", "step", "end")


def message_kinds(first: Column, last: Column) -> Column:
    """The messages a row of an episode gives, in order: start before its first, a step each, end after its last."""
    start, step, end = (F.lit(m) for m in MESSAGES)
    return F.array_compact(F.array(F.when(first, start), step, F.when(last, end)))


def only_message(messages: Column) -> Column:
    """The one message of a list; another number of them is an error."""
    return F.when(F.size(messages) == 1, messages[0]).otherwise(F.raise_error(F.concat(F.lit("one message expected, not "), F.size(messages).cast("string"))).cast("string"))
