"""Policies: blocks, failures, robots rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of a block in a short answer, in order, and what they are called.
BLOCK_SIGNS = (
    ("captcha|recaptcha|hcaptcha|turnstile", "captcha challenge"),
    ("unusual traffic|automated queries|automated access", "automated-query block"),
    ("access denied|forbidden|not authorised|not authorized", "access denied"),
    ("rate ?limit|too many requests|try again later", "rate limited"),
    ("enable javascript and cookies to continue|please enable js", "javascript required"),
    ("consent\\.google|before you continue|accept all cookies", "consent interstitial"),
)
# Words that tell a block or an unreachable host in an error message.
BLOCKED = r"(?i)blocked|captcha|challenge|\b429\b|\b403\b|forbidden|automated|consent|rate.?limit"
UNREACHABLE = r"(?i)ENOTFOUND|ECONNREFUSED|EHOSTUNREACH|ENETUNREACH|EAI_AGAIN|UND_ERR_CONNECT_TIMEOUT|UND_ERR_DNS|UND_ERR_SOCKET|CERT_|ERR_TLS|UNABLE_TO_VERIFY|SELF_SIGNED"


def block_reason(status: Column, body: Column) -> Column:
    """Why an answer is no result page, or null."""
    text = F.coalesce(body, F.lit(""))
    short = F.length(text) < 512
    out = F.when(status == 429, "HTTP 429 (rate limited)").when(status == 403, "HTTP 403 (blocked)").when((status == 503) & text.rlike("(?i)captcha|challenge"), "HTTP 503 (challenge)").when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
    for pattern, reason in BLOCK_SIGNS:
        out = out.when(short & text.rlike(f"(?i){pattern}"), reason)
    return out.when(short & ~text.rlike(r"(?i)<a\s[^>]*href="), "empty response body (likely blocked)")


def failure_kind(message: Column) -> Column:
    return F.when(message.rlike(BLOCKED), "blocked").when(message.rlike(UNREACHABLE), "unreachable").otherwise("other")


def is_retryable(status: Column) -> Column:
    return status.isin(408, 425, 429) | (status >= 500)


def robots_groups(text: str | None) -> list[tuple[list[str], list[tuple[bool, str]], float | None]]:
    """Groups of a robots file: agents, rules in order, delay in seconds. Neighbouring agent lines share a group."""
    groups: list[tuple[list[str], list[tuple[bool, str]], float | None]] = []
    naming = False
    for raw in (text or "").replace("\r\n", "\n").split("\n"):
        field, sep, value = raw.split("#", 1)[0].strip().partition(":")
        if not sep:
            continue
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            if not naming:
                groups.append(([], [], None))
            groups[-1][0].append(value.lower())
            naming = True
            continue
        naming = False
        if not groups:
            groups.append((["*"], [], None))
        agents, rules, delay = groups[-1]
        if field in ("allow", "disallow"):
            rules.append((field == "allow", value))
        elif field == "crawl-delay":
            try:
                seconds = float(value)
            except ValueError:
                continue
            if 0 <= seconds < float("inf"):
                groups[-1] = (agents, rules, min(seconds, 30.0))
    return groups


def robots_for(text: str | None, agent: str = "*") -> dict:
    """The rules of the group that names the agent most closely; ``*`` comes last."""
    agent = agent.lower()

    def closeness(names: list[str]) -> int:
        return max((0 if n == "*" else len(n) + 1 if n in agent or agent in n else -1 for n in names), default=-1)

    groups = robots_groups(text)
    best = max(groups, key=lambda g: closeness(g[0]), default=None)  # the first of equals
    if best is None or closeness(best[0]) < 0:
        return {"rules": [], "delay_ms": None}
    return {"rules": [{"allow": a, "pattern": p} for a, p in best[1]], "delay_ms": None if best[2] is None else int(best[2] * 1000)}


def robots_rules(c: Column, agent: str = "*") -> Column:
    """struct<rules array<struct<allow,pattern>>, delay_ms> of a robots file."""

    @F.pandas_udf("rules array<struct<allow:boolean,pattern:string>>, delay_ms int")
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([robots_for(x, agent) for x in s], columns=["rules", "delay_ms"])

    return parse(c)


def path_allowed(rules: Column, path: Column) -> Column:
    """Whether a path may be fetched: the longest matching pattern decides, and allowing wins ties; no match allows."""

    def pattern(p: Column) -> Column:
        quoted = F.regexp_replace(F.regexp_replace(p, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
        return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(F.endswith(p, F.lit("$")), F.lit("$")).otherwise(F.lit("")))

    hits = F.filter(rules, lambda r: (r.pattern != "") & F.regexp_like(path, pattern(r.pattern)))
    ranked = F.transform(hits, lambda r: F.struct(F.length(F.regexp_replace(r.pattern, r"[*$]", "")).alias("n"), r.allow.alias("allow")))
    return F.coalesce(F.array_max(ranked)["allow"], F.lit(True))
