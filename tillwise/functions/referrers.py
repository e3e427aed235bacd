"""Referring URLs to readable source names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import first_match, free_name
from .suffix_rules import host_labels

# Labels and the URL parts they stand for. The first match wins and a part
# may stand anywhere in the URL, so "t.co" also takes every host that ends in "t.com".
NO_REFERRER = "Direct/Unknown"
APP_SCHEME = "android-app://"
APPS = (
    ("com.google.android.gm", "Google Mail App"),
    ("com.google.android.googlequicksearchbox", "Google Search App"),
    ("com.facebook.katana", "Facebook App"),
    ("com.instagram.android", "Instagram App"),
)
OTHER_APP = "Other Mobile App"
INTERNAL_PATHS = (
    "/apps/track",
    "/cart",
    "/my-account",
    "/shop/",
    "/search",
    "/collections/",
    "/products/",
    "/pages/",
)
PAID_MARKS = ("utm_source=facebook", "fbclid=", "gad_source=1", "campaign_id=")
SITES_BEFORE_GOOGLE = (
    (("instagram.com",), "Instagram"),
    (("facebook.com",), "Facebook"),
    (("t.co",), "Twitter"),
    (("youtube.com", "youtu.be"), "YouTube"),
    (("linkedin.com",), "LinkedIn"),
    (("reddit.com",), "Reddit"),
    (("meta.com",), "Meta"),
)
GOOGLE = "google.com"
GOOGLE_ADS = ("googleads.g.doubleclick.net", "googlesyndication.com")
SITES_AFTER_GOOGLE = (
    (("brave.com",), "Brave"),
    (("bing.com",), "Bing"),
    (("ecosia.org",), "Ecosia"),
    (("chatgpt.com",), "ChatGPT"),
    (("shopify.com",), "Shopify Platform"),
    (("webinvoke.paytmpayments.com",), "Webinvoke"),
    (("l.wl.co",), "WL Link"),
    (("links.rediff.com",), "Rediff Links"),
    (("idevaffiliate.com",), "iDevAffiliate"),
)
NO_DOMAIN = "Other (No Domain)"
NO_LABEL = "Other (Generic Domain Fallback)"
FAILED = "Other (Error)"

NETLOC = r"^https?://([^/?#]*)"

# Common public suffixes. Pass the full public list for complete coverage.
COMMON_SUFFIXES = (
    "com net org edu gov mil int info biz name pro mobi app dev io ai co me tv cc ws xyz "
    "online site shop store tech club blog page cloud live news link "
    "ac ae af am ar at au az be bg br by ca ch cl cn cz de dk ee eg es eu fi fr ge gr hk hr "
    "hu id ie il in ir is it jp ke kr kz lk lt lu lv ma md mx my ng nl no nz om pe ph pk pl "
    "pt qa ro rs ru sa se sg si sk th tn tr tw ua uk us uy uz ve vn za "
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk "
    "co.in net.in org.in firm.in gen.in ind.in ac.in edu.in gov.in "
    "com.au net.au org.au edu.au gov.au co.nz net.nz org.nz co.za org.za "
    "co.jp ne.jp or.jp ac.jp co.kr or.kr com.br net.br org.br com.mx com.ar com.cn net.cn "
    "org.cn com.tw com.hk com.sg com.my com.tr com.ua com.pk com.ng com.eg com.sa co.id "
    "co.il co.th co.ke com.ph com.vn com.pl com.co com.pe com.ve"
).split()


@dataclass(frozen=True)
class Suffixes:
    """Public suffix rules: plain names, ``*.x`` wildcards and ``!x`` exceptions."""

    plain: frozenset[str]
    wildcard: frozenset[str] = field(default_factory=frozenset)
    exception: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def from_rules(cls, rules: Iterable[str]) -> Suffixes:
        """Read rules as the public list writes them, comments and blank lines included."""
        words = [line.split()[0] for line in rules if line.strip() and not line.startswith("//")]
        return cls(
            plain=frozenset(w for w in words if w[0] not in "*!"),
            wildcard=frozenset(w[2:] for w in words if w.startswith("*.")),
            exception=frozenset(w[1:] for w in words if w.startswith("!")),
        )

    @property
    def depth(self) -> int:
        """The most labels a suffix can have."""
        names = [*self.plain, *[f"*.{name}" for name in self.wildcard]]
        return max(name.count(".") + 1 for name in names)

    def match(self, name: Column, labels: int) -> Column:
        """Whether ``name``, of at most ``labels`` labels, is a public suffix of that many."""

        def of_length(names: Iterable[str], length: int) -> list[str]:
            return sorted(n for n in names if n.count(".") + 1 == length)

        parent = F.regexp_replace(name, r"^[^.]*\.", "")
        found = _any_of(name, of_length(self.plain, labels))
        found = found | _any_of(parent, of_length(self.wildcard, labels - 1))
        return found & ~_any_of(name, of_length(self.exception, labels))


def _any_of(name: Column, names: list[str]) -> Column:
    return name.isin(*names) if names else F.lit(False)


DEFAULT_SUFFIXES = Suffixes(plain=frozenset(COMMON_SUFFIXES))


@dataclass(frozen=True)
class Store:
    """The shop's own site: the label to show and the URL parts that identify it."""

    label: str
    domains: Sequence[str]


def _has(url: Column, parts: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [url.contains(part) for part in parts])


def _title(text: Column) -> Column:
    """Upper case for the first letter after anything that is no letter, else lower."""
    # Spark's own form knows spaces only: a marked one is put before such letters and taken out.
    spaced = F.regexp_replace(text, r"(?<=\P{L})(?=\p{L})", f"{_MARK} ")
    return F.replace(F.initcap(spaced), F.lit(f"{_MARK} "), F.lit(""))


_MARK = "\ue000"


def _as_name(label: Column) -> Column:
    return _title(F.replace(label, F.lit("-"), F.lit(" ")))


def site_label(host: Column, suffixes: Suffixes = DEFAULT_SUFFIXES) -> Column:
    """The host's label in front of its longest public suffix; ``''`` if there is none.

    A host under no known suffix gives its last label, an IPv4 address itself.
    """
    label = F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), host)
    for labels in range(suffixes.depth, 0, -1):
        tail = F.substring_index(host, ".", -labels)
        longer = F.substring_index(host, ".", -labels - 1)
        before = F.when(host == tail, "").otherwise(F.substring_index(longer, ".", 1))
        label = label.when(suffixes.match(tail, labels), before)
    return label.otherwise(F.substring_index(host, ".", -1))


def clean_referrer(
    site: Column, stores: Sequence[Store] = (), suffixes: Suffixes = DEFAULT_SUFFIXES
) -> Column:
    """The source name of a referring URL; never null."""
    url = _url(site)
    netloc = _netloc(url)
    label = site_label(_host(netloc), suffixes)
    return _name(site, url, netloc, label, stores)


def with_referrer(
    df: DataFrame,
    column: str,
    name: str,
    stores: Sequence[Store] = (),
    suffixes: Suffixes | DataFrame = DEFAULT_SUFFIXES,
) -> DataFrame:
    """Add ``name``, the source name of the URL in ``column``.

    Each value that several rules look at is a column of its own for a while, so it is worked
    out once, in generated code. With a table of suffix rules (see ``suffix_rules``) the distinct
    URLs are named, by a join of their distinct hosts with the rules, and joined back; rows
    without a URL are spread over all tasks of that join.
    """
    if isinstance(suffixes, DataFrame):
        return _with_joined_referrer(df, column, name, stores, suffixes)
    url, netloc, host, label = (free_name([*df.columns, name], part) for part in _PARTS)
    parted = df.withColumn(url, _url(F.col(column)))
    parted = parted.withColumn(netloc, _netloc(F.col(url)))
    parted = parted.withColumn(host, _host(F.col(netloc)))
    parted = parted.withColumn(label, site_label(F.col(host), suffixes))
    parts = [F.col(part) for part in (url, netloc, label)]
    named = parted.withColumn(name, _name(F.col(column), *parts, stores))
    return named.drop(url, netloc, host, label)


_PARTS = ("_url", "_netloc", "_host", "_label")
# Into how many keys rows without a URL are spread.
SPREAD = 4096


def _with_joined_referrer(
    df: DataFrame, column: str, name: str, stores: Sequence[Store], rules: DataFrame
) -> DataFrame:
    names = referrer_names(df.select(F.col(column).alias("site")), stores, rules)
    key, site = (free_name([*df.columns, name], part) for part in ("_key", "_site"))
    place = F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD)).cast("string")
    known = F.concat(F.lit("="), F.col(column).cast("string"))
    keyed = df.drop(name).withColumn(key, F.coalesce(known, place))
    names = names.select(F.concat(F.lit("="), "site").alias(site), F.col("source").alias(name))
    joined = keyed.join(names, F.col(key) == F.col(site), "left").drop(key, site)
    return joined.withColumn(name, F.coalesce(name, F.lit(NO_REFERRER)))


def referrer_names(
    sites: DataFrame, stores: Sequence[Store], rules: DataFrame
) -> DataFrame:
    """``site`` and its ``source`` name for every distinct ``site``, by a table of suffix rules; a null
    site drops out."""
    distinct = sites.where(F.col("site").isNotNull()).select(F.col("site").cast("string")).distinct()
    url = distinct.withColumn("url", _url(F.col("site")))
    parted = url.withColumn("netloc", _netloc(F.col("url")))
    parted = parted.withColumn("host", _host(F.col("netloc")))
    labelled = parted.join(host_labels(parted, rules), "host")
    parts = [F.col(part) for part in ("site", "url", "netloc", "label")]
    return labelled.select("site", _name(*parts, stores).alias("source"))


def _url(site: Column) -> Column:
    bare = F.regexp_replace(F.lower(site), r"(?U)^\d+", "")
    return F.when(bare.rlike("^https?://"), bare).otherwise(F.concat(F.lit("http://"), bare))


def _netloc(url: Column) -> Column:
    return F.regexp_extract(url, NETLOC, 1)


def _host(netloc: Column) -> Column:
    return F.rtrim(F.regexp_extract(netloc, r"^(?:.*@)?([^:]*)", 1), F.lit("."))


def _name(
    site: Column, url: Column, netloc: Column, label: Column, stores: Sequence[Store]
) -> Column:
    source = F.when(site.isNull() | site.rlike(r"(?U)^\s*$"), NO_REFERRER)
    source = source.when(F.lower(site).startswith(APP_SCHEME), _app(F.lower(site)))
    return F.coalesce(source.otherwise(_source(url, netloc, label, stores)), F.lit(FAILED))


def _app(site: Column) -> Column:
    return first_match([(site.contains(part), label) for part, label in APPS], OTHER_APP)


def _source(url: Column, netloc: Column, label: Column, stores: Sequence[Store]) -> Column:
    """The first rule that applies; a URL no rule knows is named after its domain."""
    cases = []
    for store in stores:
        own = _has(url, store.domains)
        cases.append((own & _has(url, INTERNAL_PATHS), f"{store.label} (Internal)"))
        cases.append((own & _has(url, PAID_MARKS), f"{store.label} (Paid Ads)"))
        cases.append((own, store.label))
    cases += [(_has(url, parts), name) for parts, name in SITES_BEFORE_GOOGLE]
    cases.append((url.contains(GOOGLE), _google(url, netloc)))
    cases += [(_has(url, parts), name) for parts, name in SITES_AFTER_GOOGLE]
    return first_match(cases, _domain(netloc, label))


def _google(url: Column, netloc: Column) -> Column:
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    # A parameter q or s (also percent-encoded) that is not blank.
    searched = query.rlike("(^|&)(q|s|%71|%73)=[^&]")
    return (
        F.when(_has(url, GOOGLE_ADS), "Google Ads")
        .when(netloc.contains("[") != netloc.contains("]"), FAILED)
        .when(searched, "Google Search")
        .otherwise("Google Direct")
    )


def _domain(netloc: Column, label: Column) -> Column:
    """The name made from the registered domain, with the fallbacks for odd hosts."""
    tail = F.split(F.regexp_replace(netloc, r"^(www|m|l)\.", ""), r"\.")
    fallback = (
        F.when(netloc == "", NO_DOMAIN)
        .when(F.size(tail) >= 2, _as_name(F.get(tail, F.size(tail) - 2)))
        .otherwise(NO_LABEL)
    )
    return F.when(label != "", _as_name(label)).otherwise(fallback)
