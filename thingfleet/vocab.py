"""Prefixes, fixed values and the term table of the device description vocabulary."""

from __future__ import annotations

TD = "https://www.w3.org/2019/wot/td#"
JSONSCHEMA = "https://www.w3.org/2019/wot/json-schema#"
WOTSEC = "https://www.w3.org/2019/wot/security#"
HCTL = "https://www.w3.org/2019/wot/hypermedia#"
DCTERMS = "http://purl.org/dc/terms/"
SCHEMA = "http://schema.org/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

PREFIXES = {
    "td": TD,
    "jsonschema": JSONSCHEMA,
    "wotsec": WOTSEC,
    "hctl": HCTL,
    "dcterms": DCTERMS,
    "schema": SCHEMA,
    "rdf": RDF,
    "xsd": XSD,
}

# The two context addresses that results must carry.
CONTEXT_V10 = "https://www.w3.org/2019/wot/td/v1"
CONTEXT_V11 = "https://www.w3.org/2022/wot/td/v1.1"

# Default prefix of graph names; every function that names graphs takes another.
GRAPH_PREFIX = "http://example.com/graph/"

RDF_TYPE = RDF + "type"
LANG_STRING = RDF + "langString"


def iri(short: str) -> str:
    """Expand ``prefix:name``."""
    prefix, name = short.split(":", 1)
    return PREFIXES[prefix] + name


# JSON Schema type names and security scheme names with their classes.
SCHEMA_TYPES = {
    "object": "jsonschema:ObjectSchema",
    "array": "jsonschema:ArraySchema",
    "string": "jsonschema:StringSchema",
    "number": "jsonschema:NumberSchema",
    "integer": "jsonschema:IntegerSchema",
    "boolean": "jsonschema:BooleanSchema",
    "null": "jsonschema:NullSchema",
}
SECURITY_SCHEMES = {
    "nosec": "wotsec:NoSecurityScheme",
    "auto": "wotsec:AutoSecurityScheme",
    "combo": "wotsec:ComboSecurityScheme",
    "basic": "wotsec:BasicSecurityScheme",
    "digest": "wotsec:DigestSecurityScheme",
    "apikey": "wotsec:APIKeySecurityScheme",
    "bearer": "wotsec:BearerSecurityScheme",
    "psk": "wotsec:PSKSecurityScheme",
    "oauth2": "wotsec:OAuth2SecurityScheme",
}

# The operation names a form may carry.
OPERATIONS = [
    "readProperty",
    "writeProperty",
    "observeProperty",
    "unobserveProperty",
    "invokeAction",
    "queryAction",
    "cancelAction",
    "subscribeEvent",
    "unsubscribeEvent",
    "readAllProperties",
    "writeAllProperties",
    "readMultipleProperties",
    "writeMultipleProperties",
    "observeAllProperties",
    "unobserveAllProperties",
    "subscribeAllEvents",
    "unsubscribeAllEvents",
    "queryAllActions",
]

# The term table. Each context (the kind of JSON object a key stands in) maps keys to
# (predicate, value). A value is one of
#   string, boolean, double, integer, unsignedInt, dateTime, anyURI   literal of that type
#   number      double in number schemas, integer otherwise, by the JSON value itself
#   text        English text          texts   map from language tag to text
#   iri         resource address      op / schemaType / scheme / class   word of a vocabulary
#   any         literal typed by the JSON value
#   >Context    one node or an array of nodes        *Context   map from name to node
_DATA_SCHEMA = {
    "@type": ("rdf:type", "class"),
    "type": ("rdf:type", "schemaType"),
    "title": ("td:title", "text"),
    "titles": ("td:titleInLanguage", "texts"),
    "description": ("td:description", "text"),
    "descriptions": ("td:descriptionInLanguage", "texts"),
    "const": ("jsonschema:const", "any"),
    "default": ("jsonschema:default", "any"),
    "unit": ("schema:unitCode", "string"),
    "oneOf": ("jsonschema:oneOf", ">DataSchema"),
    "enum": ("jsonschema:enum", "any"),
    "readOnly": ("jsonschema:readOnly", "boolean"),
    "writeOnly": ("jsonschema:writeOnly", "boolean"),
    "format": ("jsonschema:format", "string"),
    "items": ("jsonschema:items", ">DataSchema"),
    "minItems": ("jsonschema:minItems", "unsignedInt"),
    "maxItems": ("jsonschema:maxItems", "unsignedInt"),
    "minimum": ("jsonschema:minimum", "number"),
    "exclusiveMinimum": ("jsonschema:exclusiveMinimum", "number"),
    "maximum": ("jsonschema:maximum", "number"),
    "exclusiveMaximum": ("jsonschema:exclusiveMaximum", "number"),
    "multipleOf": ("jsonschema:multipleOf", "number"),
    "properties": ("jsonschema:properties", "*DataSchema"),
    "required": ("jsonschema:required", "string"),
    "minLength": ("jsonschema:minLength", "unsignedInt"),
    "maxLength": ("jsonschema:maxLength", "unsignedInt"),
    "pattern": ("jsonschema:pattern", "string"),
    "contentEncoding": ("jsonschema:contentEncoding", "string"),
    "contentMediaType": ("jsonschema:contentMediaType", "string"),
}
_AFFORDANCE = {
    "@type": ("rdf:type", "class"),
    "title": ("td:title", "text"),
    "titles": ("td:titleInLanguage", "texts"),
    "description": ("td:description", "text"),
    "descriptions": ("td:descriptionInLanguage", "texts"),
    "forms": ("td:hasForm", ">Form"),
    "uriVariables": ("td:hasUriTemplateSchema", "*DataSchema"),
}
TERMS: dict[str, dict[str, tuple[str, str]]] = {
    "Thing": {
        "@type": ("rdf:type", "class"),
        "title": ("td:title", "text"),
        "titles": ("td:titleInLanguage", "texts"),
        "description": ("td:description", "text"),
        "descriptions": ("td:descriptionInLanguage", "texts"),
        "version": ("td:versionInfo", ">VersionInfo"),
        "created": ("dcterms:created", "dateTime"),
        "modified": ("dcterms:modified", "dateTime"),
        "support": ("td:supportContact", "anyURI"),
        "base": ("td:baseURI", "anyURI"),
        "properties": ("td:hasPropertyAffordance", "*PropertyAffordance"),
        "actions": ("td:hasActionAffordance", "*ActionAffordance"),
        "events": ("td:hasEventAffordance", "*EventAffordance"),
        "links": ("td:hasLink", ">Link"),
        "forms": ("td:hasForm", ">Form"),
        "security": ("td:hasSecurityConfiguration", "string"),
        "securityDefinitions": ("td:definesSecurityScheme", "*SecurityScheme"),
        "profile": ("td:followsProfile", "anyURI"),
        "schemaDefinitions": ("td:schemaDefinitions", "*DataSchema"),
        "uriVariables": ("td:hasUriTemplateSchema", "*DataSchema"),
        "registration": ("td:registration", ">Registration"),
    },
    "Registration": {
        "created": ("dcterms:created", "dateTime"),
        "modified": ("dcterms:modified", "dateTime"),
    },
    "VersionInfo": {
        "instance": ("td:instance", "string"),
        "model": ("td:model", "string"),
    },
    "PropertyAffordance": {
        **_DATA_SCHEMA,
        **_AFFORDANCE,
        "observable": ("td:isObservable", "boolean"),
    },
    "ActionAffordance": {
        **_AFFORDANCE,
        "input": ("td:hasInputSchema", ">DataSchema"),
        "output": ("td:hasOutputSchema", ">DataSchema"),
        "safe": ("td:isSafe", "boolean"),
        "idempotent": ("td:isIdempotent", "boolean"),
        "synchronous": ("td:isSynchronous", "boolean"),
    },
    "EventAffordance": {
        **_AFFORDANCE,
        "subscription": ("td:hasSubscriptionSchema", ">DataSchema"),
        "data": ("td:hasNotificationSchema", ">DataSchema"),
        "dataResponse": ("td:hasNotificationResponseSchema", ">DataSchema"),
        "cancellation": ("td:hasCancellationSchema", ">DataSchema"),
    },
    "Form": {
        "@type": ("rdf:type", "class"),
        "href": ("hctl:hasTarget", "anyURI"),
        "contentType": ("hctl:forContentType", "string"),
        "contentCoding": ("hctl:forContentCoding", "string"),
        "response": ("hctl:returns", ">ExpectedResponse"),
        "additionalResponses": ("hctl:additionalReturns", ">AdditionalExpectedResponse"),
        "op": ("hctl:hasOperationType", "op"),
        "subprotocol": ("hctl:forSubProtocol", "string"),
        "security": ("td:hasSecurityConfiguration", "string"),
        "scopes": ("wotsec:scopes", "string"),
    },
    "Link": {
        "@type": ("rdf:type", "class"),
        "href": ("hctl:hasTarget", "anyURI"),
        "type": ("hctl:hintsAtMediaType", "string"),
        "rel": ("hctl:hasRelationType", "string"),
        "anchor": ("hctl:hasAnchor", "anyURI"),
        "sizes": ("hctl:hasSizes", "string"),
        "hreflang": ("hctl:hasHreflang", "string"),
    },
    "ExpectedResponse": {
        "contentType": ("hctl:forContentType", "string"),
    },
    "AdditionalExpectedResponse": {
        "schema": ("hctl:hasAdditionalOutputSchema", "string"),
        "success": ("hctl:isSuccess", "boolean"),
        "contentType": ("hctl:forContentType", "string"),
    },
    "SecurityScheme": {
        "@type": ("rdf:type", "class"),
        "scheme": ("rdf:type", "scheme"),
        "description": ("td:description", "text"),
        "descriptions": ("td:descriptionInLanguage", "texts"),
        "proxy": ("wotsec:proxy", "iri"),
        "in": ("wotsec:in", "string"),
        "name": ("wotsec:name", "string"),
        "qop": ("wotsec:qop", "string"),
        "authorization": ("wotsec:authorization", "iri"),
        "alg": ("wotsec:alg", "string"),
        "format": ("wotsec:format", "string"),
        "identity": ("wotsec:identity", "string"),
        "token": ("wotsec:token", "iri"),
        "refresh": ("wotsec:refresh", "iri"),
        "scopes": ("wotsec:scopes", "string"),
        "flow": ("wotsec:flow", "string"),
        "oneOf": ("wotsec:oneOf", "string"),
        "allOf": ("wotsec:allOf", "string"),
    },
    "DataSchema": _DATA_SCHEMA,
    # nodes below members that a document's own context explains
    "Own": {"@type": ("rdf:type", "class")},
}

# The predicate that keeps the name of a node held in a map from name to node.
NAME_PREDICATE = {
    "jsonschema:properties": "jsonschema:propertyName",
    "td:definesSecurityScheme": "td:hasInstanceConfiguration",
}
DEFAULT_NAME_PREDICATE = "td:name"

# The three event names on the wire.
EVENT_TYPES = ("thing_created", "thing_updated", "thing_deleted")
