"""Shape rules as data: the device description catalogue, and helpers for rules of one's own.

A rule is one constraint on one path of one shape. The catalogue is written as properties of
shapes and expanded by :func:`expand`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..vocab import LANG_STRING, OPERATIONS, SCHEMA_TYPES, TD, XSD, iri

RULES_SCHEMA = (
    "shape string, target_class string, path array<string>, kind string, arg_num bigint, "
    "arg_str string, arg_list array<string>, node_shape string, profile string"
)
STRICT, CORRECTED, BOTH, OPTIONAL = "strict", "corrected", "both", "optional"


@dataclass(frozen=True)
class Rule:
    shape: str
    target_class: str | None
    path: tuple[str, ...]
    kind: str
    arg_num: int | None = None
    arg_str: str | None = None
    arg_list: tuple[str, ...] | None = None
    node_shape: str | None = None
    profile: str = BOTH
    default: str | None = None


@dataclass(frozen=True)
class Property:
    """A property of a shape: where, what kind of value, how many, from which list."""

    path: tuple[str, ...]
    value: str = "any"
    least: int = 0
    most: int | None = None
    among: tuple[str, ...] | None = None
    node: str | None = None
    unique_lang: bool = False
    default: str | None = None


def prop(path: str | tuple[str, ...], value: str = "any", most: int | None = None, **more) -> Property:
    paths = (path,) if isinstance(path, str) else path
    return Property(tuple(iri(p) for p in paths), value, most=most, **more)


def node(path: str | tuple[str, ...], shape: str, most: int | None = None, least: int = 0) -> Property:
    return prop(path, "node", most, node=shape, least=least)


# Value kinds: text = literal with a language; word = string literal; loose = string type only;
# uri = anyURI type only; uriword = anyURI literal; ref = address typed anyURI (which no term can
# be, so the corrected profile takes an address or an anyURI literal); iri = address.

# Property groups that several shapes share.
TITLE = prop("td:title", "text", 1)
TITLES = Property((iri("td:titleInLanguage"),), "node", node="MultiLanguage", unique_lang=True)
DESCRIPTION = prop("td:description", "text", 1)
DESCRIPTIONS = Property(
    (iri("td:descriptionInLanguage"),), "node", node="MultiLanguage", unique_lang=True
)
HUMAN = [TITLE, TITLES, DESCRIPTION, DESCRIPTIONS]
IN = prop(
    "wotsec:in", "word", 1, among=("header", "query", "body", "cookie", "auto"), default="header"
)
API_KEY_IN = prop(
    "wotsec:in", "word", 1, among=("header", "query", "body", "cookie", "uri", "auto"),
    default="header",
)
NAME = prop("wotsec:name", "word", 1)
URI_VARIABLES = node("wotsec:uriVariables", "DataSchema", 1)
AUTHORIZATION = prop("wotsec:authorization", "ref", 1)
IDENTITY = prop("wotsec:identity", "word", 1)
FORMAT = prop("wotsec:format", "word", 1, default="jwt")
ALG = prop("wotsec:alg", "word", 1, default="ES256")
ONE_OF = prop("wotsec:oneOf", "word", least=2)
ALL_OF = prop("wotsec:allOf", "word", least=2)


def _schemas(*names: str, most: int | None = 1) -> list[Property]:
    return [node(n, "DataSchema", most) for n in names]


# The shapes, their target classes and their properties.
SHAPES: dict[str, tuple[str, list[Property]]] = {
    "Thing": (
        "td:Thing",
        [
            prop("td:title", "text", 1, least=1),
            TITLES,
            DESCRIPTION,
            DESCRIPTIONS,
            node("td:versionInfo", "VersionInfo", 1),
            prop("dcterms:created", "dateTime", 1),
            prop("dcterms:modified", "dateTime", 1),
            prop("td:supportContact", "uri", 1),
            prop("td:baseURI", "uri", 1),
            node(
                ("td:hasPropertyAffordance", "td:hasActionAffordance", "td:hasEventAffordance"),
                "InteractionAffordance",
            ),
            node("td:hasPropertyAffordance", "PropertyAffordance"),
            node("td:hasActionAffordance", "ActionAffordance"),
            node("td:hasEventAffordance", "EventAffordance"),
            node("td:hasLink", "Link"),
            node("td:hasForm", "Form"),
            prop("td:hasSecurityConfiguration", "loose", least=1),
            node("td:definesSecurityScheme", "SecurityScheme", least=1),
            prop("td:followsProfile", "uri"),
            node("td:schemaDefinitions", "DataSchema"),
            node("td:hasUriTemplateSchema", "DataSchema"),
        ],
    ),
    "InteractionAffordance": (
        "td:InteractionAffordance",
        [*HUMAN, node("td:hasForm", "Form", least=1), node("td:hasUriTemplateSchema", "DataSchema")],
    ),
    "PropertyAffordance": (
        "td:PropertyAffordance",
        [prop("td:isObservable", "boolean", 1, default="false")],
    ),
    "ActionAffordance": (
        "td:ActionAffordance",
        [
            *_schemas("td:hasInputSchema", "td:hasOutputSchema"),
            prop("td:isSafe", "boolean", 1, default="false"),
            prop("td:isIdempotent", "boolean", 1, default="false"),
            prop("td:isSynchronous", "boolean", 1),
        ],
    ),
    "EventAffordance": (
        "td:EventAffordance",
        _schemas(
            "td:hasSubscriptionSchema",
            "td:hasNotificationSchema",
            "td:hasNotificationResponseSchema",
            "td:hasCancellationSchema",
        ),
    ),
    "MultiLanguage": ("td:MultiLanguage", []),
    "VersionInfo": (
        "td:VersionInfo",
        [prop("td:instance", "word", 1, least=1), prop("td:model", "word", 1)],
    ),
    "Form": (
        "hctl:Form",
        [
            prop("hctl:hasTarget", "uriword", 1, least=1),
            prop("hctl:forContentType", "word", 1, default="application/json"),
            prop("hctl:forContentCoding", "word", 1),
            node("hctl:returns", "ExpectedResponse", 1),
            node("hctl:additionalReturns", "AdditionalExpectedResponse"),
            prop("hctl:hasOperationType", "iri", among=tuple(TD + o for o in OPERATIONS)),
            prop("hctl:forSubProtocol", "word", 1),
            prop("td:hasSecurityConfiguration", "word"),
            prop("wotsec:scopes", "word"),
        ],
    ),
    "Link": (
        "hctl:Link",
        [
            prop("hctl:hasTarget", "uriword", 1, least=1),
            prop("hctl:hintsAtMediaType", "word", 1),
            prop("hctl:hasRelationType", "loose", 1),
            prop("hctl:hasAnchor", "uri", 1),
            prop("hctl:hasSizes", "loose", 1),
            prop("hctl:hasHreflang", "loose"),
        ],
    ),
    "ExpectedResponse": (
        "hctl:ExpectedResponse",
        [prop("hctl:forContentType", "word", 1, least=1)],
    ),
    "AdditionalExpectedResponse": (
        "hctl:AdditionalExpectedResponse",
        [
            prop("hctl:hasAdditionalOutputSchema", "word", 1),
            prop("hctl:isSuccess", "boolean", 1, default="false"),
            prop("hctl:forContentType", "word", 1),
        ],
    ),
    "SecurityScheme": (
        "wotsec:SecurityScheme",
        [
            prop("rdf:type", "iri", 1, least=1),
            DESCRIPTION,
            DESCRIPTIONS,
            prop("wotsec:proxy", "ref", 1),
        ],
    ),
    "NoSecurityScheme": ("wotsec:NoSecurityScheme", []),
    "AutoSecurityScheme": ("wotsec:AutoSecurityScheme", []),
    "ComboSecurityScheme": ("wotsec:ComboSecurityScheme", [ONE_OF, ALL_OF]),
    "BasicSecurityScheme": ("wotsec:BasicSecurityScheme", [IN, NAME]),
    "DigestSecurityScheme": (
        "wotsec:DigestSecurityScheme",
        [prop("wotsec:qop", "word", 1, among=("auth", "auth-int"), default="auth"), IN, NAME],
    ),
    "APIKeySecurityScheme": ("wotsec:APIKeySecurityScheme", [API_KEY_IN, NAME]),
    "BearerSecurityScheme": (
        "wotsec:BearerSecurityScheme",
        [AUTHORIZATION, ALG, FORMAT, IN, NAME],
    ),
    "PSKSecurityScheme": ("wotsec:PSKSecurityScheme", [IDENTITY]),
    "OAuth2SecurityScheme": (
        "wotsec:OAuth2SecurityScheme",
        [
            AUTHORIZATION,
            prop("wotsec:token", "ref", 1),
            prop("wotsec:refresh", "ref", 1),
            prop("wotsec:scopes", "word"),
            prop("wotsec:flow", "word", 1, least=1),
        ],
    ),
    "DataSchema": (
        "jsonschema:DataSchema",
        [
            prop("rdf:type", "schemaType", 1, among=tuple(iri(v) for v in SCHEMA_TYPES.values())),
            *HUMAN,
            prop("jsonschema:const", most=1),
            prop("jsonschema:default", most=1),
            prop("schema:unitCode", "word", 1),
            *_schemas("jsonschema:oneOf", most=None),
            prop("jsonschema:readOnly", "boolean", 1, default="false"),
            prop("jsonschema:writeOnly", "boolean", 1, default="false"),
            prop("jsonschema:format", "word", 1),
        ],
    ),
    "ArraySchema": (
        "jsonschema:ArraySchema",
        [
            *_schemas("jsonschema:items", most=None),
            prop("jsonschema:minItems", "unsignedInt", 1),
            prop("jsonschema:maxItems", "unsignedInt", 1),
        ],
    ),
    "BooleanSchema": ("jsonschema:BooleanSchema", []),
    "NumberSchema": (
        "jsonschema:NumberSchema",
        [
            prop("jsonschema:" + n, "double", 1)
            for n in ("minimum", "exclusiveMinimum", "maximum", "exclusiveMaximum", "multipleOf")
        ],
    ),
    "IntegerSchema": (
        "jsonschema:IntegerSchema",
        [
            prop("jsonschema:" + n, "integer", 1)
            for n in ("minimum", "exclusiveMinimum", "maximum", "exclusiveMaximum", "multipleOf")
        ],
    ),
    "ObjectSchema": (
        "jsonschema:ObjectSchema",
        [*_schemas("jsonschema:properties", most=None), prop("jsonschema:required", "word")],
    ),
    "StringSchema": (
        "jsonschema:StringSchema",
        [
            prop("jsonschema:minLength", "unsignedInt", 1),
            prop("jsonschema:maxLength", "unsignedInt", 1),
            prop("jsonschema:pattern", "word", 1),
            prop("jsonschema:contentEncoding", "word", 1),
            prop("jsonschema:contentMediaType", "word", 1),
        ],
    ),
    "NullSchema": ("jsonschema:NullSchema", []),
}

_LITERAL, _IRI = "literal", "iri"


def _value_rules(p: Property) -> list[tuple[str, str | None, tuple[str, ...] | None, str]]:
    """(kind, arg_str, arg_list, profile) for the kind of value a property takes."""
    simple = {
        "text": [("nodeKind", _LITERAL), ("datatype", LANG_STRING)],
        "word": [("nodeKind", _LITERAL), ("datatype", XSD + "string")],
        "loose": [("datatype", XSD + "string")],
        "uri": [("datatype", XSD + "anyURI")],
        "uriword": [("nodeKind", _LITERAL), ("datatype", XSD + "anyURI")],
        "iri": [("nodeKind", _IRI)],
    }
    if p.value in simple:
        return [(k, a, None, BOTH) for k, a in simple[p.value]]
    if p.value == "ref":
        return [
            ("nodeKind", _IRI, None, STRICT),
            ("datatype", XSD + "anyURI", None, STRICT),
            ("reference", None, None, CORRECTED),
        ]
    if p.value == "schemaType":
        return [
            ("nodeKind", _LITERAL, None, STRICT),
            ("datatype", XSD + "string", None, STRICT),
            ("nodeKind", _IRI, None, CORRECTED),
        ]
    if p.value == "double":
        # whole numbers written without a point arrive as integers
        return [
            ("datatype", XSD + "double", None, STRICT),
            ("datatypeIn", None, (XSD + "double", XSD + "integer"), CORRECTED),
        ]
    if p.value in ("boolean", "dateTime", "integer", "unsignedInt"):
        return [("datatype", XSD + p.value, None, BOTH)]
    return []


def expand(shapes: dict[str, tuple[str, list[Property]]]) -> list[Rule]:
    """One rule per constraint of every property."""
    out = []
    for shape, (target, properties) in shapes.items():
        cls = iri(target) if ":" in target and not target.startswith("urn:") else target
        for p in properties:
            add = lambda kind, **kw: out.append(Rule(shape, cls, p.path, kind, **kw))  # noqa: B023, E731
            combo = shape == "ComboSecurityScheme"
            if p.least:
                add("minCount", arg_num=p.least, profile=STRICT if combo else BOTH)
            if p.most is not None:
                add("maxCount", arg_num=p.most)
            for kind, arg, listed, profile in _value_rules(p):
                add(kind, arg_str=arg, arg_list=listed, profile=profile)
            if p.among:
                add("in", arg_list=p.among)
            if p.unique_lang:
                add("uniqueLang")
            if p.node and p.node != "MultiLanguage":
                # a shape without constraints of its own cannot fail
                add("node", node_shape=p.node)
        if not properties:
            out.append(Rule(shape, cls, (), "target"))
    out.append(
        Rule(
            "ComboSecurityScheme",
            iri("wotsec:ComboSecurityScheme"),
            ONE_OF.path + ALL_OF.path,
            "exactlyOneOf",
            arg_num=2,
            profile=CORRECTED,
        )
    ) if "ComboSecurityScheme" in shapes else None
    return out


def catalogue() -> list[Rule]:
    return expand(SHAPES)


def defaults(shapes: dict[str, tuple[str, list[Property]]] = SHAPES) -> dict[tuple[str, str], str]:
    """(shape, predicate) to the value it has when absent."""
    return {
        (shape, p.path[0]): p.default
        for shape, (_, properties) in shapes.items()
        for p in properties
        if p.default is not None
    }


def as_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [
        (
            r.shape,
            r.target_class,
            list(r.path),
            r.kind,
            r.arg_num,
            r.arg_str,
            list(r.arg_list) if r.arg_list else None,
            r.node_shape,
            r.profile,
        )
        for r in rules
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> list[Rule]:
    """The rules of a table of the same schema. Rules are part of the query, like those written in code."""
    return [
        Rule(
            r.shape, r.target_class, tuple(r.path or ()), r.kind, r.arg_num, r.arg_str,
            tuple(r.arg_list) if r.arg_list else None, r.node_shape, r.profile,
        )
        for r in spark.read.schema(RULES_SCHEMA).format(fmt).load(path).toLocalIterator()
    ]
