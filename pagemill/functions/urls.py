"""URL rules (E8, F2 host) as native expressions.

``absolute_url`` resolves a reference against a base URL the way RFC 3986
section 5.2 does, on strings: no URI object is built per row, so malformed
input never fails a task.  Fragment-only, empty and malformed references give ``""``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, text

# RFC 3986 appendix B split: scheme, authority, path, query, fragment.
_URI_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
_PREFIX_RE = r"^((?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?)[^?#]*(?:\?[^#]*)?(?:#.*)?$"  # scheme and authority in one
_HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)"
_HAS_DOTS = r"(^|/)\.\.?(/|$)"


def _part(c: Column, i: int) -> Column:
    return F.regexp_extract(c, _URI_RE, i)


def url_host(c) -> Column:
    """Lower-cased host name of an absolute URL, without port or user info;
    ``""`` when there is none."""
    col = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_extract(text(col), _HOST_RE, 1))


def url_path(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return _part(text(col), 3)


def url_query(c) -> Column:
    """The query with its question mark, or ``""``."""
    col = F.col(c) if isinstance(c, str) else c
    return _part(text(col), 4)


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 5.2.4 on an absolute path, as a fold over its segments."""
    def fold(segs: Column) -> Column:
        kept = F.aggregate(
            segs, F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
            .otherwise(F.array_append(acc, s)))
        tail = F.when(F.element_at(segs, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(kept, tail), "/")

    # A path of only dot segments collapses to "/".
    return F.coalesce(F.nullif(let(F.split(path, "/"), fold), F.lit("")), F.lit("/"))


# The last ".." of an absolute path that is not at its end, with the segment it takes back.
_STEP_BACK = r"(?s)^((?:/.*)?)/(?!\.\.?/)[^/]+/\.\.(/.*)\z"


def _clean(path: Column) -> Column:
    """``path`` without dot segments; one ".." behind a segment, the usual case, needs no fold."""
    def fewer(p: Column) -> Column:
        return let(F.regexp_replace(p, _STEP_BACK, "$1$2"), lambda q: F.when(q.rlike(_HAS_DOTS), remove_dot_segments(q)).otherwise(q))

    return let(path, lambda p: F.when(p.rlike(_HAS_DOTS), fewer(p)).otherwise(p))


# A path and nothing else, if it does not begin with two slashes.
_PATH_RE = r"^[A-Za-z0-9/._~-]+\z"
# References of these characters are well formed; others are looked at closely.
_PLAIN_RE = r"^[A-Za-z0-9/._~?=&+,;#-]*$"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
# Control characters; a percent sign without two hex digits before the query or in the fragment.
_BAD_TEXT_RE = rf"[\x00-\x1F\x7F]|(?s)^[^?#]*{_BAD_ESCAPE}|(?s)#.*{_BAD_ESCAPE}"
# Without a scheme, the first segment of a relative path holds no colon.
_BAD_SEGMENT_RE = r"^[^/?#]*:"
# An authority: user info, then a bracketed address or a name, then a port.
_AUTHORITY_RE = (r"^//(?:[A-Za-z0-9._~!$&'()*+,;=:%-]*@)?(?:\[[0-9A-Fa-f:.]*(?:%25[^\[\]]*)?\]|"
                 r"(?:[A-Za-z0-9._~!$&'()*+,;=<>\"-]|[^\x00-\x7F]|%(?:25|[89A-Fa-f][0-9A-Fa-f]))*)(?::[0-9]*)?$")


def malformed(ref: Column) -> Column:
    """Whether a trimmed reference cannot be parsed: control characters, broken percent
    escapes, a colon that ends no scheme, or an authority with stray brackets, a port that
    is no number or characters that no host name has."""
    authority, scheme = _part(ref, 2), _part(ref, 1)
    return ~ref.rlike(_PLAIN_RE) & (ref.rlike(_BAD_TEXT_RE) | ((scheme == "") & ref.rlike(_BAD_SEGMENT_RE))
                                    | ((authority != "") & ~authority.rlike(_AUTHORITY_RE)))


def absolute_url(base, ref) -> Column:
    """Resolve ``ref`` against ``base``.

    Cases: empty, ``#...`` or malformed -> ``""``; has a scheme -> itself; ``//host`` ->
    base scheme; ``/path`` -> base origin; ``?query`` -> base path; anything
    else -> merged with the base directory.  Dot segments are removed.
    """
    pair = F.struct(text(F.col(base) if isinstance(base, str) else base).alias("b"),
                    F.trim(text(F.col(ref) if isinstance(ref, str) else ref)).alias("r"))
    return let(pair, lambda x: _resolve(_base_parts(x["b"]), x["r"]))


def base_parts(base) -> Column:
    """What references are resolved against, for ``resolve``: computed once where many references share a base."""
    parts = lambda b: F.struct(*[c.alias(n) for n, c in _base_parts(b).items()])
    return let(text(F.col(base) if isinstance(base, str) else base), parts)


def resolve(parts, ref) -> Column:
    """``absolute_url`` against the ``base_parts`` of the base."""
    pair = F.struct((F.col(parts) if isinstance(parts, str) else parts).alias("b"),
                    F.trim(text(F.col(ref) if isinstance(ref, str) else ref)).alias("r"))
    return let(pair, lambda x: _resolve({n: x["b"][n] for n in _PARTS}, x["r"]))


_PARTS = ("prefix", "scheme", "path", "folder")


def _base_parts(b: Column) -> dict[str, Column]:
    folder = let(_part(b, 3), lambda path: F.when((path == "") & (_part(b, 2) != ""), F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)?", 1)))
    return dict(zip(_PARTS, (F.regexp_extract(b, _PREFIX_RE, 1), _part(b, 1), _part(b, 3), folder)))


def _resolve(base: dict[str, Column], r: Column) -> Column:
    r_path, r_rest = _part(r, 3), F.concat(_part(r, 4), _part(r, 5))
    prefix = base["prefix"]
    return (
        F.when(r.rlike(_PATH_RE) & ~r.startswith("//"), F.concat(prefix, _clean(F.when(r.startswith("/"), r).otherwise(F.concat(base["folder"], r)))))
        .when((r == "") | r.startswith("#") | malformed(r), F.lit(""))
        .when(_part(r, 1) != "", r)
        .when(r.startswith("//"), F.concat(base["scheme"], F.lit(":"), r))
        .when(r.startswith("/"), F.concat(prefix, _clean(r_path), r_rest))
        .when(r.startswith("?"), F.concat(prefix, base["path"], r))
        .otherwise(F.concat(prefix, _clean(F.concat(base["folder"], r_path)), r_rest))
    )
