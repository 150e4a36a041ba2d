"""The product dictionary: which products make a filing row relevant."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ProductDictionary:
    generic_names: Sequence[str]
    brand_names: Sequence[str]
    brand_to_generic: Mapping[str, str]
    manufacturers_of_record: Sequence[str] = ()
    other_share_threshold_pct: float = 5.0

    @property
    def terms(self) -> list[str]:
        """Search terms in lower case: generics first, then brands, each in list order."""
        return [t.lower() for t in [*self.generic_names, *self.brand_names]]

    def generic_of(self) -> dict[str, str]:
        """Term in lower case to generic. A generic maps to itself, in lower case."""
        resolved = {brand.lower(): generic for brand, generic in self.brand_to_generic.items()}
        resolved.update({g.lower(): g.lower() for g in self.generic_names})
        return resolved


# The product list of the public analysis.
GLP1 = ProductDictionary(
    generic_names=["semaglutide", "tirzepatide"],
    brand_names=["Ozempic", "Wegovy", "Rybelsus", "Mounjaro", "Zepbound"],
    brand_to_generic={
        "Ozempic": "semaglutide",
        "Wegovy": "semaglutide",
        "Rybelsus": "semaglutide",
        "Mounjaro": "tirzepatide",
        "Zepbound": "tirzepatide",
    },
    manufacturers_of_record=["Novo Nordisk", "Eli Lilly"],
    other_share_threshold_pct=5.0,
)


def load_dictionary(spark: SparkSession, path: str) -> ProductDictionary:
    """Read a dictionary file (one small JSON document) from any file system Spark can reach."""
    doc = json.loads(spark.read.text(path, wholetext=True).head()[0])
    return ProductDictionary(
        generic_names=doc["generic_names"],
        brand_names=doc["brand_names"],
        brand_to_generic=doc["brand_to_generic"],
        manufacturers_of_record=doc.get("manufacturers_of_record", []),
        other_share_threshold_pct=float(
            (doc.get("manufacturer_sanity_check") or {}).get("threshold_pct", 5.0)
        ),
    )
