"""Rewrites of SQL text: JavaScript operators and a few other dialect words become what Spark parses. String literals and names are left alone."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<text>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`)|(?P<note>--[^\n]*|/\*.*?\*/)|(?P<op>===|!==|==|!=|&&|\|\||//|\*\*)|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<blank>\s+)|(?P<rest>.)""",
    re.S,
)
_FUNCTIONS = {
    "list_value": "array", "string_split": "split", "strptime": "to_timestamp", "regexp_matches": "regexp_like", "string_agg": "listagg", "epoch_ms": "unix_millis", "list_contains": "array_contains",
    "len": "length", "list_sum": "array_sum", "prefix": "startswith", "suffix": "endswith", "strlen": "octet_length", "stddev": "stddev_samp", "variance": "var_samp", "quantile_cont": "percentile",
}
#: Words after which || can't be a condition any more.
_NOT_WHERE = {"select", "group", "order", "limit", "union", "intersect", "except", "from"}


def rewrite(sql: str, condition: bool = False) -> str:
    """``==`` and ``===`` become ``=``, ``&&`` AND, ``||`` OR where it stands in a condition (it stays concatenation in a select list), comparisons with null IS [NOT] NULL, "name" `name`.

    ``condition`` says that the text is a predicate rather than a query.
    """
    tokens = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(sql)]
    out: list[str] = []
    depth_where: list[bool] = [condition]
    i = 0
    while i < len(tokens):
        kind, t = tokens[i]
        low = t.lower()
        ahead = [j for j in range(i + 1, len(tokens)) if tokens[j][0] not in ("blank", "note")]
        following = tokens[ahead[0]][1].lower() if ahead else ""
        if kind == "name" and t[0] == '"':
            out.append("`" + t[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif kind == "op" and t in ("==", "===", "!=", "!=="):
            if following == "null":
                out.append("IS NULL" if t[0] == "=" else "IS NOT NULL")
                i = ahead[0]
            else:
                out.append("=" if t[0] == "=" else "!=")
        elif t == "=" and following == "null" and depth_where[-1]:
            out.append("IS NULL")
            i = ahead[0]
        elif kind == "op" and t == "&&":
            out.append("AND")
        elif kind == "op" and t == "||":
            out.append("OR" if depth_where[-1] else "||")
        elif kind == "op" and t == "//":
            out.append("div")
        elif kind == "word" and following == "(" and low in _FUNCTIONS:
            out.append(_FUNCTIONS[low])
        elif kind == "word" and low == "exclude" and following == "(":
            out.append("EXCEPT")
        else:
            if kind == "word" and low in ("where", "having", "on", "qualify"):
                depth_where[-1] = True
            elif kind == "word" and low in _NOT_WHERE:
                depth_where[-1] = False
            elif t == "(":
                depth_where.append(depth_where[-1])
            elif t == ")" and len(depth_where) > 1:
                depth_where.pop()
            out.append(t)
        i += 1
    return "".join(out)
