"""The translation service: settings, stored and built-in profiles, request bodies, a translator over HTTP.

Settings are rows, so that the runs of many users resolve in one pass; all but the calls themselves are Column expressions."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import replies as R
from quire.functions import text as X
from quire.operators.enrich import ServiceError

PROFILE = "struct<id: string, label: string, preset: string, baseURL: string, apiKey: string, model: string, temperature: double, concurrency: int, maxTokens: int, jsonMode: boolean, extraBody: string>"
DEFAULT_TEMPERATURE = 0.2
DEFAULT_CONCURRENCY = 4
#: Built-in profiles as id, label, base url, default model, JSON mode; the last one stands for unknown ids.
PRESETS = [
    ("deepseek", "DeepSeek", "https://api.deepseek.com/v1", "deepseek-chat", True),
    ("openai", "OpenAI", "https://api.openai.com/v1", "gpt-4o-mini", True),
    ("siliconflow", "SiliconFlow", "https://api.siliconflow.cn/v1", "Qwen/Qwen2.5-7B-Instruct", True),
    ("zhipu", "Zhipu GLM", "https://open.bigmodel.cn/api/paas/v4", "glm-4-flash", True),
    ("moonshot", "Moonshot Kimi", "https://api.moonshot.cn/v1", "moonshot-v1-8k", True),
    ("dashscope", "Alibaba DashScope", "https://dashscope.aliyuncs.com/compatible-mode/v1", "qwen-plus", True),
    ("ark", "Volcengine Ark", "https://ark.cn-beijing.volces.com/api/v3", "doubao-pro-32k", True),
    ("openrouter", "OpenRouter", "https://openrouter.ai/api/v1", "openai/gpt-4o-mini", True),
    ("ollama", "Ollama (local)", "http://localhost:11434/v1", "qwen2.5:7b", False),
    ("lmstudio", "LM Studio (local)", "http://localhost:1234/v1", "local-model", False),
    ("custom", "Custom (OpenAI compatible)", "", "", False),
]


@dataclass(frozen=True)
class Config:
    """Settings of a run with their defaults; first_page and last_page count from 1, and 0 leaves a side open."""

    active_profile: str = "deepseek"
    concurrency: int = DEFAULT_CONCURRENCY
    temperature: float = DEFAULT_TEMPERATURE
    request_timeout_sec: int = 120
    max_retries: int = 3
    batch_chars: int = 1800
    system_prompt_extra: str = ""
    source_lang: str = "auto"
    target_lang: str = "zh-CN"
    first_page: int = 0
    last_page: int = 0
    glossary: str = ""
    quality_audit: bool = True
    resume_partial: bool = True
    original_on_left: bool = True
    column_gap_pt: float = 12.0
    draw_divider: bool = True
    output_mode: str = "same-dir"
    custom_output_dir: str = ""
    suffix: str = ".bilingual.zh-CN"
    overwrite: bool = False
    cache_enabled: bool = False

    @classmethod
    def of(cls, values: Mapping[str, str]) -> Config:
        """Texts by name over the defaults, as in properties; unknown names are left alone. Raises ValueError on a value of another type."""
        known = {f.name: type(f.default) for f in fields(cls)}
        return replace(cls(), **{k: _typed(k, v, known[k]) for k, v in values.items() if k in known})


def _typed(name: str, value: str, kind: type) -> object:
    try:
        return {"true": True, "false": False}[value.strip().lower()] if kind is bool else kind(value)
    except (KeyError, ValueError):
        raise ValueError(f"{name} is no {kind.__name__}: {value!r}") from None


def _presets() -> Column:
    row = lambda p: F.struct(*[F.lit(v).alias(n) for n, v in zip(("id", "label", "url", "model", "json_mode"), p, strict=True)])
    return F.array(*[row(p) for p in PRESETS])


def preset(name: Column) -> Column:
    """The built-in profile of an id; the custom one where there is none."""
    return F.coalesce(F.get(F.filter(_presets(), lambda p: p["id"] == name), F.lit(0)), F.get(_presets(), F.lit(len(PRESETS) - 1)))


def stored_profiles(providers: Column) -> Column:
    """Profiles of a JSON list; what is no list, or can't be read, is an empty one."""
    listed = F.when(X.strip(providers).startswith("["), F.from_json(providers, f"array<{PROFILE}>"))
    return F.filter(F.coalesce(listed, F.array().cast(f"array<{PROFILE}>")), lambda p: p.isNotNull())


def _first_filled(*values: Column) -> Column:
    return F.trim(F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit("")))


def active_profiles(settings: DataFrame) -> DataFrame:
    """settings(setting_id, providers, active, base_url, api_key, model, temperature, concurrency) -> the profile each one runs with.

    The stored profile of the active id, else the first stored one, else the built-in one; flat settings go before its fields. error says what is missing."""
    wanted = F.coalesce(F.nullif("active", F.lit("")), F.lit(PRESETS[0][0]))
    s = settings.withColumn("_stored", stored_profiles(F.col("providers")))
    s = s.withColumn("_own", F.coalesce(F.get(F.filter("_stored", lambda p: p["id"] == F.col("active")), F.lit(0)), F.get("_stored", F.lit(0))))
    s = s.withColumn("_preset", preset(F.when(F.col("_own").isNull(), wanted).otherwise(F.col("_own.preset"))))
    bare = F.col("_own").isNull()
    out = s.select(
        "setting_id",
        F.coalesce("_own.id", "_preset.id").alias("profile_id"),
        _first_filled(F.col("base_url"), F.col("_own.baseURL"), F.col("_preset.url")).alias("base_url"),
        _first_filled(F.col("api_key"), F.col("_own.apiKey")).alias("api_key"),
        _first_filled(F.col("model"), F.col("_own.model"), F.when(bare, F.col("_preset.model"))).alias("model"),
        F.coalesce("temperature", "_own.temperature", F.lit(DEFAULT_TEMPERATURE)).alias("temperature"),
        F.coalesce("concurrency", "_own.concurrency", F.lit(DEFAULT_CONCURRENCY)).alias("concurrency"),
        F.col("_own.maxTokens").alias("max_tokens"),
        F.coalesce(F.when(bare, F.col("_preset.json_mode")).otherwise(F.col("_own.jsonMode")), F.lit(True)).alias("json_mode"),
        F.col("_own.extraBody").alias("extra_body"),
    )
    missing = F.when(F.col("base_url") == "", F.lit("No service is configured.")).when(F.col("model") == "", F.lit("No model is configured."))
    return out.withColumn("error", missing)


def offered_profiles(settings: DataFrame) -> DataFrame:
    """setting_id, position, profile_id, label: built-in profiles that no stored one replaces, then the stored ones."""
    stored = stored_profiles(F.col("providers"))
    s = settings.select("setting_id", F.transform(stored, lambda p: F.struct(p["id"].alias("id"), F.coalesce(F.nullif(p["label"], F.lit("")), p["id"]).alias("label"))).alias("own"))
    taken = F.transform("own", lambda p: F.coalesce(p["id"], F.lit("")))
    built_in = F.transform(F.filter(_presets(), lambda p: ~F.array_contains(taken, p["id"])), lambda p: F.struct(p["id"].alias("id"), p["label"].alias("label")))
    return s.select("setting_id", F.posexplode(F.concat(built_in, "own")).alias("position", "p")).select("setting_id", "position", F.col("p.id").alias("profile_id"), F.col("p.label").alias("label"))


_OBJECT = "map<string, variant>"


def request_body(model: Column, system: Column, user: Column, temperature: Column | None = None, max_tokens: Column | None = None, extra: Column | None = None, json_mode: Column | None = None) -> Column:
    """A chat completion request as JSON. Fields of extra, a JSON object, go before the request's own but for the reply's format where JSON is asked for."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))
    temperature = F.lit(None).cast("double") if temperature is None else temperature
    tokens = F.lit(None).cast("int") if max_tokens is None else F.nullif(max_tokens, F.lit(0))
    own = F.struct(
        model.alias("model"), F.array(message("system", system), message("user", user)).alias("messages"),
        F.coalesce(temperature, F.lit(DEFAULT_TEMPERATURE)).alias("temperature"), tokens.alias("max_tokens"),
    )
    wants = F.coalesce(F.lit(True) if json_mode is None else json_mode, F.lit(True))
    form = F.when(wants, F.lit('{"response_format":{"type":"json_object"}}')).otherwise(F.lit("{}"))
    more = F.lit("{}") if extra is None else F.coalesce(extra, F.lit("{}"))
    more = F.coalesce(F.from_json(more, _OBJECT), F.from_json(F.lit("{}"), _OBJECT))
    late = F.from_json(form, _OBJECT)
    over = lambda low, high: F.map_concat(F.map_filter(low, lambda k, _: ~F.array_contains(F.map_keys(high), k)), high)
    return F.to_json(over(over(F.from_json(F.to_json(own), _OBJECT), more), late))


def requests(batched: DataFrame, model: str, system: str, temperature: float = DEFAULT_TEMPERATURE, max_tokens: int | None = None, extra: str | None = None, json_mode: bool = True) -> DataFrame:
    """batched(doc_id, batch, para_index, source) -> doc_id, batch, body: one request a batch, whose units are numbered from 0 in their order. A batch is bounded by its budget."""
    units = F.array_sort(F.collect_list(F.struct("para_index", F.col("source").alias("t"))))
    per = batched.groupBy("doc_id", "batch").agg(units.alias("units"))
    user = R.user_prompt(F.transform("units", lambda u, i: F.struct(i.alias("i"), u["t"].alias("t"))))
    body = request_body(F.lit(model), F.lit(system), user, F.lit(temperature), F.lit(max_tokens).cast("int"), F.lit(extra).cast("string"), F.lit(json_mode))
    return per.select("doc_id", "batch", body.alias("body"))


@dataclass(frozen=True)
class HttpTranslator:
    """A service that speaks the chat completion protocol; made inside the task that calls it."""

    base_url: str
    model: str
    api_key: str = ""
    temperature: float = DEFAULT_TEMPERATURE
    max_tokens: int | None = None
    json_mode: bool = True
    extra: Mapping[str, object] | None = None
    timeout: float = 120.0

    def send(self, system: str, user: str, json_mode: bool) -> tuple[str, int]:
        payload: dict = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": self.temperature}
        payload |= ({"max_tokens": self.max_tokens} if self.max_tokens else {}) | dict(self.extra or {})
        if json_mode and self.json_mode:
            payload["response_format"] = {"type": "json_object"}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(f"{self.base_url.strip().rstrip('/')}/chat/completions", json.dumps(payload).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                body = json.loads(answer.read())
        except urllib.error.HTTPError as error:
            raise ServiceError(error.code, f"The service replied {error.code}. {error.read().decode(errors='replace')[:300]}") from error
        except ValueError as error:
            raise ServiceError(200, "The reply is no JSON.") from error
        content = body["choices"][0]["message"]["content"]
        text = content if isinstance(content, str) else "".join(p.get("text") or "" for p in content)
        return text, (body.get("usage") or {}).get("total_tokens") or 0

    def complete(self, system: str, segments: list[dict]) -> tuple[str, int]:
        return self.send(system, json.dumps({"segments": segments}, ensure_ascii=False), True)


def probe(translator: HttpTranslator) -> tuple[str, int]:
    """The service's answer to a ping, cut for display, and the milliseconds it took."""
    start = time.monotonic()
    text, _ = translator.send("Answer with the word ok.", "ping", False)
    return text.strip()[:60], round(1000 * (time.monotonic() - start))
