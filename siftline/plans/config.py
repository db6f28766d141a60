"""Configuration: YAML to rules, checked in full before anything is read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions.dialect import PatternError, to_java
from . import patterns

SECONDARY = "secondary"


class ConfigError(ValueError):
    """A configuration that cannot be used; the message names the entry."""


@dataclass(frozen=True)
class Rule:
    name_paths: tuple[str, ...] = ()
    value_paths: tuple[str, ...] = ()
    name_patterns: tuple[str, ...] = ()
    min_length: int = 8
    min_entropy: float = 0.0
    high_entropy: float = 0.0
    max_similarity: float = 0.0
    ignore_names: tuple[str, ...] = ()
    ignore_prefixes: tuple[str, ...] = ()
    ignore_values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Detector:
    name: str
    patterns: tuple[tuple[str, str], ...]  # by name
    primary: str
    keywords: tuple[str, ...] = ()
    exclude_words: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    min_entropy: float = 0.0


@dataclass(frozen=True)
class Matcher:
    name: str = ""
    reason: str = ""
    path: str = ""
    expression: str = ""


@dataclass(frozen=True)
class Correlation:
    id: str
    tag: str
    match: Matcher | None = None
    partners: tuple[Matcher, ...] = ()
    when: str = ""


@dataclass(frozen=True)
class Filter:
    expression: str
    action: str = "filter"
    id: str = ""


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = ()
    detectors: tuple[Detector, ...] = ()
    filters: tuple[Filter, ...] = ()
    correlations: tuple[Correlation, ...] = ()
    info: tuple[tuple[str, str], ...] = ()
    stopwords: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()

    @property
    def window(self) -> int:
        """How many findings back partners are looked for."""
        return max([3, *(len(c.partners) for c in self.correlations)])


URL_LIKE = 'let leaf = lower(last(split(name, "."))); leaf contains "url" || leaf contains "uri" || leaf contains "endpoint" || reason startsWith "info:" || reason contains "url"'
PASSWORD = r"(?i)passw(?:or)?d|pwd"
#: Built-in correlations, in order of precedence.
CORRELATIONS = (
    Correlation("aws-credential-pair", "aws-credential-pair", Matcher(name="(?i)secret[_-]?access[_-]?key"), (Matcher(reason="^sig:aws-access-token$"),)),
    Correlation("oauth-client-credentials", "oauth-client-credentials", Matcher(name="(?i)client[_-]?secret"), (Matcher(name="(?i)client[_-]?id"),)),
    Correlation("client-secret-url", "client-secret-url", Matcher(name="(?i)client[_-]?secret"), (Matcher(expression=URL_LIKE),)),
    Correlation("jwt-url", "jwt-url", Matcher(expression='reason == "jwt_indicator" || reason == "sig:jwt" || lower(name) contains "jwt"'), (Matcher(expression=URL_LIKE),)),
    Correlation("client-id-url", "client-id-url", Matcher(name="(?i)client[_-]?id"), (Matcher(expression=URL_LIKE),)),
    Correlation("password-credentials", "password-credentials", Matcher(name=PASSWORD), (Matcher(name="(?i)user"), Matcher(expression=URL_LIKE))),
    Correlation("password-user", "password-user", Matcher(name=PASSWORD), (Matcher(name="(?i)user"),)),
    Correlation("password-url", "password-url", Matcher(name=PASSWORD), (Matcher(expression=URL_LIKE),)),
    Correlation("consumer-credentials", "consumer-credentials", Matcher(name="(?i)consumer[_-]?secret"), (Matcher(name="(?i)consumer[_-]?key"),)),
    Correlation("api-key-secret", "api-key-secret", Matcher(name="(?i)api[_-]?secret"), (Matcher(name="(?i)api[_-]?key"),)),
    Correlation("api-key-url", "api-key-url", Matcher(name="(?i)x-api-key|api[_-]?key"), (Matcher(expression=URL_LIKE),)),
    Correlation("function-url", "function-url", when='lower(name) contains "function" && lower(prev.name) contains "url"'),
)


def strings(x: object, where: str) -> tuple[str, ...]:
    if x is None:
        return ()
    if not isinstance(x, list):
        raise ConfigError(f"{where}: a list is needed")
    return tuple("" if v is None else str(v) for v in x)


def pattern(p: str, where: str) -> str:
    try:
        to_java(p)
    except PatternError as e:
        raise ConfigError(f"{where}: {e}") from e
    return p


def mapping(x: object, where: str) -> dict:
    if not isinstance(x, dict):
        raise ConfigError(f"{where}: a mapping is needed")
    return x


def entries(x: object) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def checked(source: str, env: Callable[[], ex.Env], where: str) -> str:
    """Types are checked by building columns, which needs a running session; without one only the words are read."""
    try:
        if SparkContext._active_spark_context is None:
            ex.tokens(source)
        else:
            ex.compile_bool(source, env())
    except (ex.ExpressionError, PatternError) as e:
        raise ConfigError(f"{where}: {e}") from e
    return source


def of_rule(x: dict) -> Rule:
    x = mapping(x, "rules")
    names = []
    for n in entries(x.get("name_regexes")):
        names.append(pattern(mapping(n, "name_regexes").get("regex") or "" if not isinstance(n, str) else n, "name_regexes"))
    return Rule(
        strings(x.get("name_paths"), "name_paths"), strings(x.get("value_paths"), "value_paths"), tuple(names), int(x.get("min_value_len") or 8),
        float(x.get("min_entropy") or 0), float(x.get("high_entropy_threshold") or 0), float(x.get("max_name_value_similarity") or 0),
        tuple(pattern(p, "ignore_name_patterns") for p in strings(x.get("ignore_name_patterns"), "ignore_name_patterns")),
        strings(x.get("ignore_value_prefixes"), "ignore_value_prefixes"),
        tuple(pattern(p, "ignore_value_patterns") for p in strings(x.get("ignore_value_patterns"), "ignore_value_patterns")),
    )


def of_detector(x: dict) -> Detector:
    x = mapping(x, "detectors")
    name = str(x.get("name") or "")
    if not name.strip():
        raise ConfigError("detector: a name is required")
    found = {str(k): pattern(str(v), f"detector {name}") for k, v in (x.get("regex") or {}).items()}
    if not found:
        raise ConfigError(f"detector {name}: a regex is required")
    primary = x.get("primary_regex_name") or min(found)
    if primary not in found:
        raise ConfigError(f"detector {name}: {primary} is none of its regexes")
    lowered = lambda k: tuple(w.lower() for w in strings(x.get(k), k))
    excluded = tuple(pattern(p, f"detector {name}") for p in strings(x.get("exclude_regexes_match"), "exclude_regexes_match"))
    return Detector(name, tuple(sorted(found.items())), primary, lowered("keywords"), lowered("exclude_words"), excluded, float(x.get("entropy") or 0))


def of_filter(x: object) -> Filter | None:
    x = {"filter": x} if isinstance(x, str) else mapping(x, "filter")
    source, action, id_ = str(x.get("filter") or ""), x.get("action") or "filter", str(x.get("id") or "")
    if not source.strip():
        return None
    if action not in ("filter", "tag"):
        raise ConfigError(f"filter {source!r}: unknown action {action!r}")
    if action == "tag" and not id_.strip():
        raise ConfigError(f"filter {source!r}: a tag requires an id")
    return Filter(checked(source, lambda: ex.finding_env(F.col), f"filter {source!r}"), action, id_)


def of_matcher(x: object, where: str) -> Matcher:
    x = mapping(x or {}, where)
    m = Matcher(*(str(x.get(k) or "") for k in ("name_regex", "reason_regex", "path_regex", "expr")))
    given = [p for p in (m.name, m.reason, m.path) if p]
    if m.expression.strip():
        if given:
            raise ConfigError(f"{where}: an expression goes without patterns")
        checked(m.expression, lambda: ex.finding_env(F.col), where)
    elif not given:
        raise ConfigError(f"{where}: no pattern")
    for p in given:
        pattern(p, where)
    return m


def of_correlation(x: dict) -> Correlation:
    x = mapping(x, "correlations")
    id_, when = str(x.get("id") or ""), str(x.get("when") or "")
    tag = str(x.get("tag") or id_)
    where = f"correlation {id_ or when!r}"
    if not tag.strip():
        raise ConfigError(f"{where}: an id or tag is required")
    if when.strip():
        prev = lambda n: F.col("prev")[n]
        return Correlation(id_, tag, when=checked(when, lambda: ex.pair_env(F.col, prev), where))
    match = of_matcher(x.get("match"), where)
    partners = tuple(of_matcher(p, where) for p in entries(x.get("partners")))
    if not partners:
        raise ConfigError(f"{where}: partners or a when expression is required")
    return Correlation(id_, tag, match, partners)


def of_info(x: object) -> tuple[str, str] | None:
    x = {"match": x} if isinstance(x, str) else mapping(x, "info")
    id_, source = str(x.get("id") or ""), str(x.get("match") or "")
    if not source.strip():
        return None
    if not id_.strip():
        raise ConfigError(f"info {source!r}: an id is required")
    return id_, checked(source, lambda: ex.name_value_env(F.col("name"), F.col("value")), f"info {id_}")


def compile_config(x: dict | None, stopwords: tuple[str, ...] = ()) -> RuleSet:
    """The rule set of a parsed configuration. stopwords: the general list, to which the configuration's own are added."""
    x = mapping(x or {}, "configuration")
    files = x.get("files") or {}
    own = tuple(w.strip().lower() for w in strings(x.get("stopwords"), "stopwords"))
    keep = lambda xs: tuple(v for v in xs if v is not None)
    return RuleSet(
        tuple(map(of_rule, entries(x.get("rules")))), tuple(map(of_detector, entries(x.get("detectors")))), keep(map(of_filter, entries(x.get("filter")))),
        tuple(map(of_correlation, entries(x.get("correlations")))) + CORRELATIONS, keep(map(of_info, entries(x.get("info")))) + tuple(patterns.IDENTIFIERS),
        tuple(w for w in (*stopwords, *own) if w), strings(files.get("allow"), "files.allow"), strings(files.get("deny"), "files.deny"),
    )


def load_config(path: str, stopwords: tuple[str, ...] = ()) -> RuleSet:
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("reading a configuration file needs PyYAML; compile_config takes a parsed one") from e
    with open(path, encoding="utf-8-sig") as f:
        try:
            return compile_config(yaml.safe_load(f), stopwords)
        except yaml.YAMLError as e:
            raise ConfigError(f"{path}: {e}") from e


def load_stopwords(path: str) -> tuple[str, ...]:
    """A general stop-word list: one word a line, # begins a comment. Its size is not bounded; it is a parameter of a scan."""
    with open(path, encoding="utf-8") as f:
        return tuple(w for line in f if (w := line.split("#")[0].strip().lower()))


#: The configuration a scan has unless it is given another.
NAMES = "(?i)(secret|token|api[_-]?key|password|passwd|pwd|credential|private[_-]?key|access[_-]?key|client[_-]?secret|signing[_-]?key|[_-]key|auth)"
DEFAULT = {
    "files": {
        "allow": [
            *(f"**/*.{e}" for e in "json yaml yml env xml config properties ini py pyi js jsx cjs mjs ts tsx go java cs rb php kt kts rs".split()),
            "**/.env", "**/.env.*", "",
        ],
        "deny": ["**/cerlet.ini", "**/pytest.ini", *(f"**/{d}/**" for d in "site-packages .venv test .git node_modules vendor testdata".split())],
    },
    "rules": [{
        "name_paths": ["name", "key", "field", "env.name"],
        "value_paths": ["value", "val", "secret", "env.value"],
        "name_regexes": [NAMES, {"name": "camelcase-key", "regex": "(?-i:[a-z0-9]Key([A-Z0-9_]|$))"}],
        "min_value_len": 8, "min_entropy": 2.0, "high_entropy_threshold": 0, "max_name_value_similarity": 0.85,
        "ignore_name_patterns": ["(?i)(label|text|title|description|author|error|subject|template|input|output|message|comment|summary|placeholder|forgot)"],
        "ignore_value_prefixes": [
            "vault://", "sm://", "ref+awssecrets://", "@{", "${", "%DR", "%EEA_", "%{hiera", "%{alias", "SVC_SF", "svc_", "PWD-", "BBP_BSC_", "ADLS-", "MULE-", "HTTP-", "@Microsoft.Key",
            "$ANSIBLE_VAULT", "/api", "anonymous", "RootManageSharedAccessKey", "[parameters(", "/etc/", "/assets", "<PLACE", "azure-key-vault-properties-provider", "assets/", "direct:", "your",
            "vru", "reverseproxy-", "#['https://login.microsoftonline.com", "res:", "reverseproxy",
        ],
        "ignore_value_patterns": [r"^ENC\[.*\]$", "^arn:aws:secretsmanager:", r"^projects\/[^\/]+\/secrets\/"],
    }],
    "detectors": [{"name": "acme-api-key", "keywords": ["acme"], "regex": {"key": "AKME-[0-9a-f]{32}"}, "exclude_regexes_match": ["^AKME-0+$"], "exclude_words": ["example"], "entropy": 3.0}],
    "filter": ["entropy <= 4 && name_value_similarity > 0.65", {"id": "value-pattern", "action": "tag", "filter": 'reason startsWith "sig:"'}],
}
