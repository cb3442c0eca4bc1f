"""Column functions on text and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword groups of directory names, first hit wins.
DOMAIN_KEYWORDS = (
    ("networking", "network api http request response endpoint service"),
    ("auth", "auth login signin signup account credential token"),
    ("data", "database coredata realm sqlite storage cache persist repository"),
    ("ui", "viewcontroller viewmodel view screen ui cell widget component"),
    ("navigation", "navigation router coordinator routing deeplink"),
    ("analytics", "analytics tracking metric logging event telemetry"),
    ("push", "push notification apns fcm remote"),
    ("media", "media image video audio camera photo player"),
    ("utilities", "util helper extension common shared base foundation"),
    ("maps", "map location geo coordinate gps mapkit"),
    ("settings", "setting config preference onboarding"),
    ("payments", "payment purchase billing checkout iap subscription"),
    ("app", "appdelegate scenedelegate app lifecycle launch"),
)
MODULE_MARKERS = ("Sources", "Source", "Classes", "App")


def terms(text: Column) -> Column:
    """Search terms: a space before each capital, lower case, split at all but letters, digits and CJK, longer than one."""
    cut = F.split(F.lower(F.regexp_replace(text, "([A-Z])", " $1")), "[^a-zA-Z0-9一-鿿]+")
    return F.filter(cut, lambda x: F.length(x) > 1)


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern, without a trailing slash, occurs in the path."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(path, F.lit(p.rstrip("/")))
    return out


def parent_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def module(path: Column) -> Column:
    """The part after Modules, else the part before the first of the markers that occurs, else the parent, else app."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "Modules")
    found = F.when((at > 0) & (at < F.size(parts)), F.get(parts, at.cast("int")))
    for m in MODULE_MARKERS:
        k = F.array_position(parts, m)
        found = F.coalesce(found, F.when(k > 1, F.get(parts, (k - 2).cast("int"))))
    return F.coalesce(found, parent_dir(path), F.lit("app"))


def heuristic_domain(name: Column) -> Column:
    low, out = F.lower(name), None
    for domain, words in DOMAIN_KEYWORDS:
        hit = F.lit(False)
        for w in words.split():
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, domain) if out is None else out.when(hit, domain)
    return out.otherwise(F.replace(low, F.lit(" "), F.lit("_")))


def search_doc(*parts: Column) -> Column:
    """The parts that are not empty, joined by a space."""
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in doubles; null if one is null, holds a null or is all zeros, or lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
