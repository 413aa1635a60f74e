"""Settings, products, engines by name."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace

PREFIX = "PAPYRINE_"


@dataclass(frozen=True)
class Product:
    key: str
    languages: tuple[str, ...]
    model: str
    baseline: str


#: Fixed values.
PRODUCTS = {
    "vi_en": Product("vi_en", ("vi", "en"), "vi_en_PP-OCRv5_mobile_rec", "latin_PP-OCRv5_mobile_rec"),
    "vi_en_ja": Product("vi_en_ja", ("vi", "en", "ja"), "vi_en_ja_PP-OCRv5_mobile_rec", "PP-OCRv5_mobile_rec"),
}


@dataclass(frozen=True)
class Settings:
    """UDF-08. Values come from keyword arguments, a JSON file, PAPYRINE_<FIELD> in the environment, then the defaults."""

    product: str = "vi_en"
    languages: tuple[str, ...] = ()
    output_locale: str = "en"
    table_format: str = "auto"
    figure_policy: str = "auto"
    describe_images: bool = True
    join_continuations: bool = True
    page_markers: bool = False
    review_markers: bool = True
    price_per_million: float = 0.0

    def __post_init__(self):
        if self.product not in PRODUCTS:
            raise ValueError(f"unknown product {self.product}")
        if extra := set(self.languages) - set(PRODUCTS[self.product].languages):
            raise ValueError(f"{self.product} doesn't read {', '.join(sorted(extra))}")

    @property
    def product_info(self) -> Product:
        """JN-15."""
        return PRODUCTS[self.product]

    @staticmethod
    def load(path: str | None = None, environment: Mapping[str, str] | None = None, **given) -> Settings:
        environment = os.environ if environment is None else environment
        known = {f.name: f for f in fields(Settings)}
        found = {}
        for name, f in known.items():
            if (raw := environment.get(PREFIX + name.upper())) is not None:
                found[name] = raw.lower() in ("1", "true", "yes") if f.type == "bool" else float(raw) if f.type == "float" else tuple(filter(None, raw.split(","))) if f.type.startswith("tuple") else raw
        if path:
            with open(path) as file:
                found |= {k: tuple(v) if isinstance(v, list) else v for k, v in json.load(file).items()}
        return replace(Settings(), **found, **given) if not set(found) & set(given) else replace(Settings(), **(found | given))


@dataclass
class Engines:
    """UDF-01, UDF-02: functions over batches by method; a method without one is left out of all plans."""

    by_method: dict[str, Callable] = field(default_factory=dict)

    def register(self, method: str, engine: Callable) -> Engines:
        self.by_method[method] = engine
        return self

    @property
    def available(self) -> tuple[str, ...]:
        return tuple(self.by_method)

    def describe(self) -> dict[str, str]:
        return {m: getattr(e, "__name__", type(e).__name__) for m, e in self.by_method.items()}
