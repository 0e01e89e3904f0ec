"""Column expressions shared by queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments, tags, declarations, text and stray brackets; both regex dialects read it alike.
TOKEN = r"(?s:<!--.*?-->)|</?[a-zA-Z][^>]*>|<![^>]*>|[^<]+|<"


def tokens(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(TOKEN), F.lit(0))


def token_kind(t: Column) -> Column:
    return F.when(t.startswith("<!--"), "COM").when(t.startswith("</"), "END").when(t.startswith("<!"), "DECL").when(t.rlike("^<[a-zA-Z]"), "START").otherwise("TXT")


def tag_name(t: Column) -> Column:
    return F.lower(F.regexp_extract(t, "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))


def camel_to_dash(name: Column) -> Column:
    return F.concat(F.lit("its-"), F.lower(F.regexp_replace(name, "([A-Z])", "-$1")))


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def literal_xpath(kind: Column, text: Column) -> Column:
    """Value to XPath: booleans as calls, numbers as they are, strings quoted; a text with both quotes is a concat()."""
    one, two = F.lit("'"), F.lit('"')
    both = F.concat(F.lit("concat("), F.array_join(F.transform(F.split(text, "'", -1), lambda x: F.concat(one, x, one)), ", \"'\", "), F.lit(")"))
    quoted = F.when(~text.contains("'"), F.concat(one, text, one)).when(~text.contains('"'), F.concat(two, text, two)).otherwise(both)
    return F.when(kind == "BOOL", F.concat(text, F.lit("()"))).when(kind == "NUM", text).otherwise(quoted)
