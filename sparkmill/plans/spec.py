"""Pipeline specifications: strict, versioned, unknown fields refused, every bound checked before a plan is made."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import urllib.parse
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from sparkmill.functions import strictjson
from sparkmill.functions.template import TemplateError, parts
from sparkmill.functions.validation import SchemaError, check_schema
from sparkmill.operators.dedup import check_parameters
from sparkmill.plans.contracts import ContractError, compile_contract
from sparkmill.plans.providers import Http

MOST_BYTES = 8 << 20


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Dedup:
    method: str = "exact"
    fields: list[str] | None = None
    normalize: str = "none"
    field: str | None = None
    num_perm: int = 128
    bands: int = 16
    threshold: float = 0.8
    shingle_words: int = 3
    tokenization: str = "words"
    shingle_chars: int = 3

    @property
    def charge(self) -> int:
        """Bytes that the memory budget counts for an accepted record: an entry, the slots of a signature, and an entry for
        each of its buckets."""
        return 128 if self.method == "exact" else 128 + 8 * self.num_perm + 128 * self.bands

    def check(self) -> None:
        if self.method not in ("exact", "minhash") or self.normalize not in ("none", "lowercase"):
            raise SpecError("dedup: method is exact or minhash, normalize none or lowercase")
        if self.method == "minhash" and not self.field:
            raise SpecError("dedup: minhash needs a field")
        for p in self.fields or [self.field] * (self.method == "minhash"):
            if not isinstance(p, str) or not all(p.split(".")):
                raise SpecError("dedup: a path is of names and places joined by dots")
        try:
            check_parameters(self.num_perm, self.bands, self.threshold, self.shingle_words, self.tokenization, self.shingle_chars)
        except ValueError as e:
            raise SpecError(f"dedup: {e}") from e


@dataclass(frozen=True)
class Judge:
    provider: str
    prompt: str
    score_field: str = "score"
    min_score: float = 0.0


@dataclass(frozen=True)
class Errors:
    strict: bool = False
    max_failed_records: int | None = None
    max_failed_ratio: float | None = None
    dead_letter: str | None = None


@dataclass(frozen=True)
class Price:
    input_usd_per_mtok: float
    output_usd_per_mtok: float

    def check(self, name: str) -> None:
        for v in (self.input_usd_per_mtok, self.output_usd_per_mtok):
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v < 0:
                raise SpecError(f"{name}: prices are finite and not negative")


@dataclass(frozen=True)
class Spec:
    version: int
    dataset: dict[str, Any]
    source: dict[str, Any]
    providers: dict[str, dict[str, Any]]
    generate: dict[str, Any]
    output: dict[str, Any]
    judge: Judge | None = None
    dedup: Dedup | None = None
    errors: Errors = field(default_factory=Errors)
    pricing: Price | None = None
    provider_pricing: dict[str, Price] = field(default_factory=dict)
    dedup_storage: str = "memory"
    dedup_max_bytes: int = 64 << 20

    def digest(self) -> str:
        """SHA-256 of what differs from the defaults, so that a field that is added later changes no old digest."""
        return hashlib.sha256(strictjson.dump(_told(self)).encode()).hexdigest()

    def http(self, name: str) -> Http:
        p = dict(self.providers[name])
        p.pop("type")
        retry, limit = p.pop("retry", {}), p.pop("rate_limit", {}) or {}
        return Http(**p, **retry, **limit)

    @property
    def dead_letter(self) -> str:
        return self.errors.dead_letter or self.output["path"].rstrip("/") + ".rejected"


def _told(value: Any) -> Any:
    if hasattr(value, "__dataclass_fields__"):
        blank = {f.name: f.default if f.default_factory.__class__.__name__ == "_MISSING_TYPE" else f.default_factory() for f in fields(value)}
        return {k: _told(v) for k, v in vars(value).items() if v != blank.get(k) or k not in blank}
    if isinstance(value, dict):
        return {k: _told(v) for k, v in value.items()}
    return [_told(v) for v in value] if isinstance(value, list) else value


_KEYS = {
    "dataset": {"name"}, "generate": {"provider", "prompt", "output_schema", "regenerate_on_invalid"},
    "output": {"format", "path", "commit_every", "schema", "batch_size"}, "source": {"type", "path", "records"},
}


def _strict(kind: type, name: str, value: Any) -> Any:
    if value is None:
        return None
    known = {f.name for f in fields(kind)}
    if not isinstance(value, dict) or (odd := set(value) - known):
        raise SpecError(f"{name}: unknown field {sorted(odd)[0]}" if isinstance(value, dict) else f"{name} is not an object")
    try:
        return kind(**value)
    except TypeError as e:
        raise SpecError(f"{name}: a field is missing") from e


def load(text: str, base: str = "") -> Spec:
    """A specification from JSON, or YAML where a YAML parser is installed."""
    if len(text.encode()) > MOST_BYTES:
        raise SpecError("the specification is longer than 8 MiB")
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise SpecError("not JSON, and no YAML parser is installed") from e
        try:
            value = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise SpecError("not YAML") from e
    return check(value, base)


_HTTP = {"type", "base_url", "model", "api_key_env", "concurrency", "timeout_ms", "retry", "rate_limit", "max_completion_tokens", "estimated_completion_tokens", "temperature", "top_p", "seed", "response_format"}


def _within(where: str, name: str, value: Any, least: float, most: float, whole: bool = True) -> None:
    kind = int if whole else (int, float)
    if isinstance(value, bool) or not isinstance(value, kind) or not least <= value <= most:
        raise SpecError(f"{where}: {name} is {least:g} to {most:g}")


def _known(where: str, part: Any, known: set[str]) -> dict:
    if not isinstance(part, dict):
        raise SpecError(f"{where} is not an object")
    if odd := sorted(set(part) - known):
        raise SpecError(f"{where}: unknown field {odd[0]}")
    return part


def _provider(name: str, p: Any) -> None:
    where = f"provider {name}"
    if not isinstance(p, dict) or p.get("type") not in ("mock", "openai_compatible"):
        raise SpecError(f"{where}: type is mock or openai_compatible")
    _within(where, "concurrency", p.get("concurrency", 1), 1, 1024)
    if p["type"] == "mock":
        if "response" not in _known(where, p, {"type", "response", "concurrency"}):
            raise SpecError(f"{where}: response is missing")
        _template(f"{where}: response", p["response"])
        return
    _known(where, p, _HTTP)
    if not isinstance(p.get("base_url"), str) or not isinstance(p.get("model"), str) or not p["model"].strip():
        raise SpecError(f"{where}: base_url and model are needed")
    url = urllib.parse.urlsplit(p["base_url"])
    if url.scheme not in ("http", "https") or not url.hostname or url.username or url.password or url.query or url.fragment:
        raise SpecError(f"{where}: base_url is HTTP or HTTPS, without credentials, query or fragment")
    if "api_key_env" in p and not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", str(p["api_key_env"])):
        raise SpecError(f"{where}: api_key_env is the name of a variable")
    _within(where, "timeout_ms", p.get("timeout_ms", 60_000), 1, 3_600_000)
    retry = _known(f"{where}.retry", p.get("retry", {}), {"max_attempts", "initial_delay_ms", "max_delay_ms"})
    _within(where, "retry.max_attempts", retry.get("max_attempts", 5), 1, 100)
    _within(where, "retry.initial_delay_ms", retry.get("initial_delay_ms", 500), 0, 3_600_000)
    _within(where, "retry.max_delay_ms", retry.get("max_delay_ms", 30_000), retry.get("initial_delay_ms", 500), 3_600_000)
    if p.get("rate_limit") is not None:
        limit = _known(f"{where}.rate_limit", p["rate_limit"], {"requests_per_minute", "tokens_per_minute"})
        if not limit:
            raise SpecError(f"{where}: rate_limit names a limit")
        for k, v in limit.items():
            _within(where, k, v, 1, 100_000_000)
    for k, most in (("max_completion_tokens", 2**32 - 1), ("estimated_completion_tokens", 2**32 - 1)):
        if k in p:
            _within(where, k, p[k], 1, most)
    for k, most in (("temperature", 2), ("top_p", 1)):
        if k in p:
            _within(where, k, p[k], 0, most, whole=False)
    if "seed" in p:
        _within(where, "seed", p["seed"], -(2**63), 2**63 - 1)
    form = p.get("response_format", {"type": "json_object"})
    if not isinstance(form, dict) or form.get("type") not in ("json_object", "text", "json_schema"):
        raise SpecError(f"{where}: response_format is json_object, text or json_schema")
    if form["type"] == "json_schema" and not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", str((form.get("json_schema") or {}).get("name", ""))):
        raise SpecError(f"{where}: a json_schema has a name of 1 to 64 letters, digits, dashes or underscores")


def _template(where: str, text: Any) -> None:
    if not isinstance(text, str) or not text.strip():
        raise SpecError(f"{where} is not blank")
    try:
        parts(text)
    except TemplateError as e:
        raise SpecError(f"{where}: {e}") from e


def normalized(path: str, base: str = "") -> str:
    """A local path, resolved against the folder of the specification; a path with a scheme stays."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        return path.rstrip("/")
    return os.path.normpath(os.path.join(base or os.getcwd(), path))


def check(value: Any, base: str = "") -> Spec:
    """The checked specification; the error names a field and a rule, never a value."""
    if isinstance(value, dict):
        named = value.get("provider_pricing") or {}
        value = {**value, "judge": _strict(Judge, "judge", value.get("judge")), "dedup": _strict(Dedup, "dedup", value.get("dedup")), "errors": _strict(Errors, "errors", value.get("errors")) or Errors(), "pricing": _strict(Price, "pricing", value.get("pricing")), "provider_pricing": {k: _strict(Price, f"provider_pricing.{k}", v) for k, v in named.items()} if isinstance(named, dict) else named}
    spec: Spec = _strict(Spec, "specification", value)
    if spec is None or spec.version != 1:
        raise SpecError("version is 1")
    for name, known in _KEYS.items():
        _known(name, getattr(spec, name), known)
    if not isinstance(spec.dataset.get("name"), str) or not spec.dataset["name"].strip():
        raise SpecError("dataset: name is not blank")
    if spec.source.get("type") not in ("inline", "jsonl", "csv") or ("records" if spec.source["type"] == "inline" else "path") not in spec.source:
        raise SpecError("source: type is inline with records, or jsonl or csv with a path")
    if not isinstance(spec.providers, dict) or not isinstance(spec.provider_pricing, dict):
        raise SpecError("providers and provider_pricing are objects")
    for name, p in spec.providers.items():
        _provider(name, p)
    for user in (spec.generate, vars(spec.judge) if spec.judge else None):
        if user is not None and user.get("provider") not in spec.providers:
            raise SpecError("a provider is not listed")
    _template("generate: prompt", spec.generate.get("prompt"))
    _within("generate", "regenerate_on_invalid", spec.generate.get("regenerate_on_invalid", 0), 0, 3)
    try:
        check_schema(spec.generate.get("output_schema", True))
    except SchemaError as e:
        raise SpecError(f"generate.output_schema: {e}") from e
    if spec.judge:
        _template("judge: prompt", spec.judge.prompt)
        if not isinstance(spec.judge.score_field, str) or not spec.judge.score_field.strip():
            raise SpecError("judge: score_field is not blank")
        if isinstance(spec.judge.min_score, bool) or not isinstance(spec.judge.min_score, (int, float)) or not math.isfinite(spec.judge.min_score):
            raise SpecError("judge: min_score is finite")
    o = spec.output
    if o.get("format") not in ("jsonl", "parquet") or not isinstance(o.get("path"), str) or not o["path"]:
        raise SpecError("output: format is jsonl or parquet, with a path")
    _within("output", "commit_every", o.get("commit_every", 1), 1, 65_536)
    _within("output", "batch_size", o.get("batch_size", 1024), 1, 65_536)
    if "schema" in o:
        if o["format"] != "parquet":
            raise SpecError("output.schema: needs the format parquet")
        try:
            compile_contract(o["schema"])
        except ContractError as e:
            raise SpecError(str(e)) from e
    e = spec.errors
    if (e.max_failed_ratio is not None and not 0 <= e.max_failed_ratio <= 1) or (e.max_failed_records is not None and e.max_failed_records < 0):
        raise SpecError("errors: max_failed_ratio is 0 to 1, max_failed_records 0 or more")
    if spec.dedup:
        spec.dedup.check()
    if spec.dedup_storage not in ("memory", "disk"):
        raise SpecError("dedup_storage is memory or disk")
    _within("specification", "dedup_max_bytes", spec.dedup_max_bytes, 1, 2**63 - 1)
    if spec.pricing:
        spec.pricing.check("pricing")
    for name, price in spec.provider_pricing.items():
        if name not in spec.providers:
            raise SpecError("provider_pricing: a provider is not listed")
        price.check(f"provider_pricing.{name}")
    o["path"] = normalized(o["path"], base)
    if "path" in spec.source:
        spec.source["path"] = normalized(spec.source["path"], base)
    own = [o["path"] + x for x in ("", ".partial", ".publishing", ".manifest.json", ".lock")] + [spec.dead_letter if "://" in spec.dead_letter else normalized(spec.dead_letter, base)]
    if len(set(own)) < len(own) or spec.source.get("path") in own:
        raise SpecError("the paths of source, output and errors.dead_letter meet")
    return spec


def plan(spec: Spec) -> str:
    """The steps that a run takes, one a line."""
    form = spec.source["type"]
    steps = [f"dataset {spec.dataset['name']} (version {spec.version}, digest {spec.digest()[:12]})", f"source {form}", f"generate by {spec.generate['provider']}, {spec.generate.get('regenerate_on_invalid', 0)} regenerations at most", "parse, validate"]
    if spec.judge:
        steps.append(f"judge by {spec.judge.provider}: {spec.judge.score_field} >= {spec.judge.min_score:g}")
    if spec.dedup:
        steps.append(f"dedup {spec.dedup.method}" + (f", {spec.dedup.num_perm} permutations, {spec.dedup.bands} bands, threshold {spec.dedup.threshold:g}" if spec.dedup.method == "minhash" else ""))
    policies = {k: v for k, v in asdict(spec.errors).items() if v not in (None, False) and k != "dead_letter"}
    steps += [f"sink {spec.output['format']}, commits every {spec.output.get('commit_every', 1)} rows", "policies " + (", ".join(f"{k} {v}" for k, v in sorted(policies.items())) or "none"), "publish"]
    return "\n".join(f"{k}. {x}" for k, x in enumerate(steps, 1))
