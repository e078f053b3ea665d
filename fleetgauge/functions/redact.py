"""Replace the values of sensitive keys."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "[REDACTED]"

# A key is sensitive when its lower-case form contains one of these.
SENSITIVE_WORDS = (
    "password", "token", "api_key", "secret", "credential", "key", "auth", "authorization", "passphrase",
    "private", "credit_card", "cc", "ssn", "social_security", "account", "email", "phone", "address", "zip",
    "postal", "dob", "birth", "license",
)


@lru_cache(maxsize=4096)
def is_sensitive(key: str) -> bool:
    return any(word in key.lower() for word in SENSITIVE_WORDS)


_TOKEN = re.compile(
    r'''[ \t\n\r]*(?:(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'''
    r"|(?P<scalar>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|(?P<sign>[][{}:,]))"
)


def mask_text(body: str) -> str:
    """Mask the sensitive values of a JSON text; everything else stays as it is written.

    The text is read token by token with a list of the open brackets, so depth, number formats and odd
    escapes do no harm. Scalars under a sensitive key are replaced. Objects are entered under any key, and in
    lists; a list in a list is left alone. A text that isn't JSON is replaced as a whole.
    """
    out: list[str] = []
    brackets: list[str] = []
    alone = 0  # brackets open when a list in a list began; 0: none did
    done, key, want = 0, "", "value"
    for m in iter(lambda: _TOKEN.match(body, done), None):
        kind, token = m.lastgroup, m[m.lastgroup]
        lead, done = body[done : m.start(kind)], m.end()
        inner = brackets[-1] if brackets else ""
        if kind == "text" and want in ("key", "first key"):
            key, want = json.loads(token), "colon"
        elif kind != "sign" and want in ("value", "first value"):
            if inner == "{" and not alone and is_sensitive(key):
                token = f'"{MASK}"'
            want = "next"
        elif token == ":" and want == "colon":
            want = "value"
        elif token in ("{", "[") and want in ("value", "first value"):
            brackets.append(token)
            if token == inner == "[" and not alone:
                alone = len(brackets)
            want = "first key" if token == "{" else "first value"
        elif token == "}" and inner == "{" and want in ("next", "first key") or token == "]" and inner == "[" and want in ("next", "first value"):
            alone = 0 if alone == len(brackets) else alone
            brackets.pop()
            want = "next"
        elif token == "," and brackets and want == "next":
            want = "key" if inner == "{" else "value"
        else:
            return f'"{MASK}"'
        out += [lead, token]
    if brackets or want != "next" or body[done:].strip(" \t\n\r"):
        return f'"{MASK}"'
    return "".join(out) + body[done:]




def _any_of(words: Iterable[str]) -> str:
    """A pattern of the words by their common beginnings: each place of a text is compared with few letters."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    return "|".join(re.escape(h) + (f"(?:{_any_of(t)})" if all(t) else "") for h, t in sorted(heads.items()))


#: A key with a sensitive word and the scalar after it, in JSON without escapes: text between strings holds no such word,
#: so a match can't begin at a closing quote, and only a key is followed by a colon.
_KEY = r'''"(?=[^"]*"\s*:)'''
_PAIR = rf'''({_KEY}[^"]*?(?i:{_any_of(SENSITIVE_WORDS)})[^"]*"\s*:\s*)(?:"[^"]*"|[-+.0-9A-Za-z]+)'''
#: A list in a list; within a string it only costs time.
_NESTED = r"[\[,]\s*\["
#: The one sign outside ASCII whose lower case is a letter of the words (the Kelvin sign).
_KELVIN = "\u212a"


def redact_json(body: str | Column, schema: T.StructType | str | None = None) -> Column:
    """Redact a column of JSON texts (see `mask_text`); null stays null.

    Spelling is kept: blanks, number formats and the order of keys are those of the text, only masked values change. Texts
    that parse as JSON and have neither escapes nor lists in lists are masked by one expression in the JVM.
    The others (also very deep ones and those that repeat a key), and texts that aren't JSON, go through Python token by token.

    With a schema the text is parsed, redacted by its types and written again, without fields that the
    schema lacks and in its spelling. A text that doesn't fit it is masked as a whole.
    """
    text = F.col(body) if isinstance(body, str) else body
    if schema is not None:
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        whole = T.StructType([*kind.fields, T.StructField("__bad", T.StringType())])
        parsed = F.from_json(text, whole, {"columnNameOfCorruptRecord": "__bad"})
        good = F.to_json(_typed(parsed, "", kind))
        return F.when(parsed["__bad"].isNotNull(), F.lit(f'"{MASK}"')).when(text.isNotNull(), good)

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else mask_text(t))

    # The parser doesn't mind what follows a value. Within a list only a comma or the list's end may follow it, and within an
    # object only a key: what parses in both is one value.
    parses = lambda left, right: F.try_parse_json(F.concat(F.lit(left), text, F.lit(right))).isNotNull()
    plain = parses("[", "]") & parses('{"":', "}") & ~F.contains(text, F.lit("\\")) & ~F.contains(text, F.lit(_KELVIN))
    plain = plain & ~text.rlike(_NESTED)
    # The Python part sees null for what the JVM does, and gives null for nothing else.
    return F.coalesce(run(F.when(~plain, text)), F.regexp_replace(text, _PAIR, f'$1"{MASK}"'))


def _typed(c: Column, name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        inner = [_typed(c[f.name], f.name, f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            return F.transform(c, lambda x: _typed(x, "", kind.elementType))
        return c
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(c, lambda k, v: F.when(_sensitive_column(k), F.lit(MASK)).otherwise(v))
        if isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType)):
            return F.transform_values(c, lambda _, v: _typed(v, "", kind.valueType))
        return c
    if not is_sensitive(name):
        return c
    return F.lit(MASK) if isinstance(kind, T.StringType) else F.lit(None).cast(kind)


def _sensitive_column(key: Column) -> Column:
    return F.lower(key).rlike("|".join(SENSITIVE_WORDS))


def redact_columns(df: DataFrame) -> DataFrame:
    """Redact typed columns from the schema alone; sensitive values that are no text become null."""
    return df.select(*[_typed(F.col(f"`{f.name}`"), f.name, f.dataType).alias(f.name) for f in df.schema.fields])
