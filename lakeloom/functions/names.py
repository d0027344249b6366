"""Schema names, resource types and targets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The package in which short names such as ``core.#Item`` live, and the fallback definitions there.
ROOT = "base"
FALLBACKS = ("Item", "Collection", "CatchAll")

#: Spellings of initialisms in definition names.
INITIALISMS = {
    "acl": "ACL", "api": "API", "arn": "ARN", "aws": "AWS", "cidr": "CIDR", "dns": "DNS", "ec2": "EC2", "gcp": "GCP", "http": "HTTP", "https": "HTTPS", "iam": "IAM", "id": "ID",
    "ip": "IP", "json": "JSON", "k8s": "K8s", "nat": "NAT", "rds": "RDS", "ssh": "SSH", "tcp": "TCP", "tls": "TLS", "udp": "UDP", "uid": "UID", "uri": "URI", "url": "URL", "vpc": "VPC", "yaml": "YAML",
}


def normalize_schema(name: Column, root: str = ROOT) -> Column:
    """``package.#Definition`` of any spelling: without import prefix and version, with ``.#`` as separator."""
    out = F.regexp_replace(name, f"^{re.escape(root)}\\.schemas/", "")
    out = F.regexp_replace(out, r"@v\d+", "")
    out = F.regexp_replace(out, r"^([^:]*):#?", "$1.#")
    out = F.when(out.startswith("core.#"), F.concat(F.lit(f"{root}/"), out)).otherwise(out)
    return F.regexp_replace(out, r"\.([^.#][^.]*)$", ".#$1")


def normalize_schema_name(name: str, root: str = ROOT) -> str:
    """The same for one name."""
    out = re.sub(r"@v\d+", "", name.removeprefix(f"{root}.schemas/"))
    out = re.sub(r"^([^:]*):#?", r"\1.#", out)
    if out.startswith("core.#"):
        out = f"{root}/{out}"
    return re.sub(r"\.([^.#][^.]*)$", r".#\1", out)


def schema_package(name: Column, root: str = ROOT) -> Column:
    return F.regexp_replace(normalize_schema(name, root), r"\.#[^.]*$", "")


def schema_definition(name: Column, root: str = ROOT) -> Column:
    return F.regexp_extract(normalize_schema(name, root), r"\.(#[^.]*)$", 1)


def format_schema(package: Column, definition: Column) -> Column:
    clean = F.regexp_replace(package, r"@v\d+", "")
    named = F.concat(clean, F.lit(".#"), F.regexp_replace(definition, "^#", ""))
    return F.when(package == "", "").when(F.coalesce(definition, F.lit("")) == "", clean).otherwise(named)


def same_schema(a: Column, b: Column, root: str = ROOT) -> Column:
    return normalize_schema(a, root) == normalize_schema(b, root)


def is_fallback(name: Column, root: str = ROOT) -> Column:
    return normalize_schema(name, root).isin(*(f"{root}/core.#{f}" for f in FALLBACKS))


def resource_schema(resource_type: Column, generic: str, root: str = ROOT) -> Column:
    """``linux.host`` to ``base/linux.#Host``; types without a dot are generic."""
    parts = F.split(resource_type, r"\.")
    spelled = F.create_map(*(F.lit(x) for pair in INITIALISMS.items() for x in pair))
    words = F.filter(F.split(F.element_at(parts, -1), "[_-]"), lambda w: w != "")
    name = F.array_join(F.transform(words, lambda w: F.coalesce(spelled[F.lower(w)], F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))), "")
    return F.when((F.size(parts) < 2) | (name == ""), generic).otherwise(F.concat(F.lit(f"{root}/"), parts[0], F.lit(".#"), name))


def normalize_target(target: Column) -> Column:
    """A target without its leading slashes."""
    return F.regexp_replace(target, "^//", "")


def origin_of(path: Column) -> Column:
    """The lower-case file name without its last extension."""
    name = F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.[^.]*$", "")
    return F.when(name == "", "unknown-source").otherwise(name)
