"""G1 on JSON text of any shape: values of sensitive keys are replaced at any depth, without a schema.

The text is cut into tokens by one pattern that never looks back (escape pairs, quotes, brackets, commas, colons and
what is between), and one ``aggregate`` walks them as a machine of few states.  It gives the ranges to cut, and the text
is put together around them, so what isn't cut stays as it was, spaces, number forms and order included.  Texts
that hold none of the keys' names, and no escaped letter that could spell one, are not walked at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.operators.quality import REDACTED, SENSITIVE_KEYS

#: Escape pairs, quotes, structure and anything else; every character is in one token.
TOKENS = r'\\[\s\S]|["{}\[\],:]|[^\\"{}\[\],:]+|\\$'
BLANKS = " \t\n\r"
#: States: outside strings; in a string; right after one; at the value of a sensitive key; in a string that goes;
#: in a list or object that goes, and in a string therein.
OUT, STRING, AFTER, DUE, CUT_STRING, CUT, CUT_INNER = range(7)
QUOTE, COLON, COMMA, BLANK, OTHER, OPEN, CLOSE = range(7)


def _kind(t: Column) -> Column:
    """What a token is, by its first character."""
    c = F.ascii(t)
    return (F.when(c == ord('"'), QUOTE).when(c == ord(":"), COLON).when(c == ord(","), COMMA).when(c.isin(ord("{"), ord("[")), OPEN)
            .when(c.isin(ord("}"), ord("]")), CLOSE).when(F.trim(t, F.lit(BLANKS)) == "", BLANK).otherwise(OTHER))


def redact_any_json(c: str | Column, keys: Sequence[str] = SENSITIVE_KEYS, text: str = REDACTED) -> Column:
    """``c`` with the value of every key in ``keys`` (whatever case, escapes read) replaced by a string, be it a string, number, literal, list
    or object, however deep.  NULL stays NULL.  Text that is no JSON is treated token by token: what follows a
    sensitive key and a colon goes, to the end if it never closes."""
    col = F.col(c) if isinstance(c, str) else c
    names = [k.lower() for k in keys]
    longest = 6 * max(map(len, names))                                    # a letter may be written as six
    ranges = F.array().cast("array<struct<lo:int,hi:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(OUT).alias("mode"), F.lit("").alias("word"), F.lit(0).alias("depth"), F.lit(0).alias("lo"), ranges.alias("cuts"))
    tokens = F.transform(F.regexp_extract_all(col, F.lit(TOKENS), F.lit(0)), lambda t: F.struct(t.alias("t"), _kind(t).alias("k"), F.length(t).alias("n")))

    def step(s: Column, x: Column) -> Column:
        mode, k, t, end = s["mode"], x["k"], x["t"], s["at"] + x["n"]
        word = F.when(s["word"].contains("\\"), F.get_json_object(F.concat(F.lit('{"k":"'), s["word"], F.lit('"}')), "$.k")).otherwise(s["word"])
        sensitive = F.coalesce(F.lower(word).isin(*names), F.lit(False))
        last = (mode == CUT) & (k == CLOSE) & (s["depth"] <= 1)
        plain = (mode == DUE) & (k == OTHER)
        moved = (F.when(mode == STRING, F.when(k == QUOTE, AFTER).otherwise(STRING))
                 .when(mode == CUT_STRING, F.when(k == QUOTE, OUT).otherwise(CUT_STRING))
                 .when(mode == CUT_INNER, F.when(k == QUOTE, CUT).otherwise(CUT_INNER))
                 .when(mode == CUT, F.when(k == QUOTE, CUT_INNER).when(last, OUT).otherwise(CUT))
                 .when(mode == DUE, F.when(k == BLANK, DUE).when(k == QUOTE, CUT_STRING).when(k == OPEN, CUT).otherwise(OUT))
                 .when(k == QUOTE, STRING)
                 .when(mode == AFTER, F.when(k == BLANK, AFTER).when((k == COLON) & sensitive, DUE).otherwise(OUT))
                 .otherwise(OUT))
        depth = F.when(mode == CUT, F.when(k == OPEN, s["depth"] + 1).when(k == CLOSE, s["depth"] - 1).otherwise(s["depth"])).when(mode == CUT_INNER, s["depth"]).otherwise(1)
        # a number or literal is one token; blanks around it stay
        lead = s["at"] + x["n"] - F.length(F.ltrim(t, F.lit(BLANKS)))
        cuts = (F.when(plain, F.array_append(s["cuts"], F.struct(lead.cast("int").alias("lo"), (lead + F.length(F.trim(t, F.lit(BLANKS)))).cast("int").alias("hi"))))
                .when(last | ((mode == CUT_STRING) & (k == QUOTE)), F.array_append(s["cuts"], F.struct(s["lo"].alias("lo"), end.cast("int").alias("hi"))))
                .otherwise(s["cuts"]))
        # the text of a string, kept while it can be a key
        kept = (F.when(mode != STRING, F.when(k == QUOTE, F.lit("")).otherwise(s["word"]))
                .when((k != QUOTE) & (F.length(s["word"]) <= longest), F.concat(s["word"], t)).otherwise(s["word"]))
        return F.struct(end.cast("int").alias("at"), moved.alias("mode"), kept.alias("word"), depth.cast("int").alias("depth"), F.when(mode == DUE, s["at"]).otherwise(s["lo"]).alias("lo"), cuts.alias("cuts"))

    def told(s: Column) -> Column:
        # a value that never closes goes to the end
        return F.when(s["mode"].isin(CUT_STRING, CUT, CUT_INNER), F.array_append(s["cuts"], F.struct(s["lo"].alias("lo"), s["at"].alias("hi")))).otherwise(s["cuts"])

    def joined(cuts: Column) -> Column:
        size = F.size(cuts)
        # what stands before each cut, and after the last
        kept = F.transform(F.sequence(F.lit(0), size), lambda i: F.substr(
            col, F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["hi"]) + 1,
            F.when(i == size, F.length(col)).otherwise(F.get(cuts, i)["lo"]) - F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["hi"])))
        return F.when(size == 0, col).otherwise(F.array_join(kept, f'"{text}"'))

    # bound once: the walk isn't repeated for each use of its ranges
    walked = F.transform(F.array(F.aggregate(tokens, start, step, told)), joined)[0]
    possible = F.lower(col).rlike("|".join(names) + r"|\\u")
    return F.when(possible, walked).otherwise(col)
