"""Web attack signatures as Columns: a cheap prefilter on the raw request and seven families on the decoded one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plan import computed_once
from .strings import web_decode

#: What a raw, lower-cased path and query must hold to be looked at.
PREFILTER = (
    r"union|select|sleep\(|benchmark|information_schema|group_concat|extractvalue|updatexml|waitfor|"
    r"<script|%3cscript|onerror|onload|onmouseover|javascript:|<svg|<iframe|"
    r"\$\{|jndi|%24%7b|"
    r"php://|file://|data://|expect://|phar://|%3a%2f%2f|"
    r"/etc/passwd|/etc/shadow|passwd|proc/self|win\.ini|boot\.ini|"
    r"\.\./|\.\.\\|%2e%2e|%00|"
    r"shell_exec|passthru|system\(|popen|proc_open|pcntl_exec|call_user_func|invokefunction|think|"
    r"wget|curl|chmod|/bin/|bash|/dev/tcp|nc -e|ncat|phpinfo|allow_url_include|auto_prepend|"
    r"c99|r57|wso|b374k|weevely|eval\(|assert\(|base64_decode|\$_(get|post|request|cookie)"
)
#: The families, in order of their rank.
FAMILIES = {
    "log4shell": r"\$\{jndi:|jndi:(ldap|ldaps|rmi|dns|iiop|nis|corba)|\$\{(lower|upper|env|sys|java|date|base64|main):",
    "cmdi": (
        r"\b(shell_exec|system|passthru|popen|proc_open|pcntl_exec)\s*\(|call_user_func(_array)?|invokefunction|think\\?app|"
        r";\s*(wget|curl|bash|sh|nc|ncat|python|perl|id|whoami|uname|cat)\b|\|\s*(wget|curl|bash|sh|nc|ncat)\b|&&\s*(wget|curl|chmod|sh|bash|cd)\b|"
        r"\$\([^)]+\)|`[^`]+`|\bchmod\s*\+x\b|/bin/(ba)?sh\b|bash\s+-i|nc\s+-e|>?/dev/tcp/|"
        r"\b(wget|curl)\s+https?://|\$\{ifs\}|phpinfo\s*\(|allow_url_include|auto_prepend_file"
    ),
    "webshell": (
        r"\b(c99|r57|wso|b374k|weevely|china[\s_-]?chopper)\b|(eval|assert|system|passthru|shell_exec)\s*\(\s*(base64_decode|gzinflate|str_rot13|\$_)|"
        r"\$_(get|post|request|cookie)\s*\[[^\]]*\]\s*\(|\.(phtml|phar|php[3457])\b"
    ),
    "sqli": (
        r"union(\s+all)?\s+select|\bor\s+1\s*=\s*1\b|\bor\s+'1'\s*=\s*'1|'\s*or\s*'1'\s*=\s*'1|\b(sleep|benchmark|pg_sleep)\s*\(|waitfor\s+delay|"
        r"information_schema|group_concat\s*\(|extractvalue\s*\(|updatexml\s*\(|\binto\s+(outfile|dumpfile)\b|/\*!\d"
    ),
    "lfi": (
        r"(php|file|data|expect|phar|zip|glob|compress\.\w+)://|/etc/(passwd|shadow|group|gshadow)\b|/proc/self/(environ|cmdline|maps|status)|"
        r"\bwin\.ini\b|\bboot\.ini\b|/windows/(win\.ini|system32)"
    ),
    "traversal": r"\.\.(/|\\)|\.\.%2f|\.\.%5c|%00",
    "xss": (
        r"<\s*script|</\s*script|<\s*svg|<\s*iframe|<\s*img[^>]+onerror|<\s*body[^>]+onload|on(error|load|mouseover|focus|click|animationstart)\s*=|"
        r"javascript:|vbscript:|data:text/html|document\.cookie|string\.fromcharcode|alert\s*\(|prompt\s*\("
    ),
}
#: Paths that attackers probe for.
SENSITIVE = (
    r"wp-login\.php|xmlrpc\.php|/\.env\b|/\.git\b|/\.svn\b|/\.aws\b|/\.ssh\b|phpmyadmin|adminer|phpinfo|/wp-admin\b|/administrator\b|/admin\b|"
    r"/setup\b|/config|web\.config|\.htaccess|\.htpasswd|id_rsa|/etc/passwd|/server-status\b|/actuator\b|/console\b|/cgi-bin/|"
    r"\.(sql|bak|old|backup|tar|tgz|gz|zip|7z|rar)\b"
)


def families_of(plain: Column) -> Column:
    """The families that a decoded text matches, by rank."""
    return F.array_compact(F.array(*(F.when(plain.rlike(rx), F.lit(name)) for name, rx in FAMILIES.items())))


def with_attack_families(requests: DataFrame, out: str = "families") -> DataFrame:
    """``requests`` and the families that each matches, by rank. Requests that fail the prefilter have none, whatever they
    decode to. The decoded text is a column of its own on the way, so that it is made once and not once per family; the
    others' isn't made at all."""
    raw = F.lower(F.concat_ws(" ", F.coalesce("path", F.lit("")), F.coalesce("query", F.lit(""))))
    plain = F.concat_ws(" ", web_decode(F.col("path")), web_decode(F.col("query")))
    got = computed_once(requests, {"__likely": raw.rlike(PREFILTER)})
    got = computed_once(got, {"__plain": F.when(F.col("__likely"), plain)})
    return computed_once(got, {out: F.when(F.col("__likely"), families_of(F.col("__plain"))).otherwise(F.array().cast("array<string>"))}).drop("__likely", "__plain")


def is_sensitive(path: Column) -> Column:
    return web_decode(path).rlike(SENSITIVE)
