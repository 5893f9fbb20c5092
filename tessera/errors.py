"""Errors with stable codes."""

from __future__ import annotations

#: The codes. The messages are ours.
MESSAGES = {
    "NO_LANGUAGE_WITH_CUSTOM_TOKENIZER": "a custom tokenizer decides the language itself; pass no language with it",
    "LANGUAGE_NOT_SUPPORTED": 'language "{}" is not supported',
    "INVALID_STEMMER_FUNCTION_TYPE": "the stemmer must be a function",
    "MISSING_STEMMER": 'stemming in "{}" needs a stemmer function',
    "CUSTOM_STOP_WORDS_MUST_BE_FUNCTION_OR_ARRAY": "stop words must be a list of strings, or a function that gives one",
    "UNSUPPORTED_COMPONENT": 'there is no component "{}"',
    "COMPONENT_MUST_BE_FUNCTION": 'component "{}" must be a function',
    "COMPONENT_MUST_BE_FUNCTION_OR_ARRAY_FUNCTIONS": 'component "{}" must be a function or a list of functions',
    "INVALID_SCHEMA_TYPE": 'type "{}" of "{}" is not supported',
    "DOCUMENT_ID_MUST_BE_STRING": 'a document id must be a string, not "{}"',
    "DOCUMENT_ALREADY_EXISTS": 'there is a document with the id "{}" already',
    "DOCUMENT_DOES_NOT_EXIST": 'there is no document with the id "{}"',
    "MISSING_DOCUMENT_PROPERTY": 'property "{}" is missing',
    "INVALID_DOCUMENT_PROPERTY": 'property "{}" must be "{}", not "{}"',
    "UNKNOWN_INDEX": 'property "{}" cannot be searched; these can: {}',
    "INVALID_BOOST_VALUE": "a boost must be greater than 0",
    "INVALID_FILTER_OPERATION": "a filter takes one operation, not {}",
    "SCHEMA_VALIDATION_FAILURE": 'a document does not fit the schema at "{}"',
    "INVALID_SORT_SCHEMA_TYPE": 'type "{}" of "{}" cannot be sorted',
    "CANNOT_SORT_BY_ARRAY": '"{}" is an array ({}) and cannot be sorted',
    "UNABLE_TO_SORT_ON_UNKNOWN_FIELD": 'cannot sort by "{}"; allowed are: {}',
    "SORT_DISABLED": "sorting is turned off for this collection",
    "UNKNOWN_GROUP_BY_PROPERTY": 'cannot group by "{}": there is no such property',
    "INVALID_GROUP_BY_PROPERTY": 'cannot group by "{}": allowed types are {}, not {}',
    "UNKNOWN_FILTER_PROPERTY": 'cannot filter by "{}": there is no such property',
    "UNKNOWN_VECTOR_PROPERTY": '"{}" is not a vector property',
    "INVALID_VECTOR_SIZE": 'a vector size must be greater than 0, not "{}"',
    "INVALID_VECTOR_VALUE": 'a vector value must be a number, not "{}"',
    "INVALID_INPUT_VECTOR": 'property "{}" has {} dimensions, the vector has {}',
    "WRONG_SEARCH_PROPERTY_TYPE": 'property "{}" is not a string and cannot be searched',
    "FACET_NOT_SUPPORTED": 'facets of type "{}" are not supported',
    "INVALID_DISTANCE_SUFFIX": 'unit "{}" is not one of cm, m, km, mi, yd, ft',
    "INVALID_SEARCH_MODE": 'mode "{}" is not one of fulltext, vector, hybrid',
    "MISSING_VECTOR_AND_SECURE_PROXY": "this search needs a vector, or a plugin that makes one from the term",
    "MISSING_TERM": "this search needs a term",
    "INVALID_VECTOR_INPUT": 'a vector search needs "value" and "property", got "{}"',
    "PLUGIN_CRASHED": "a plugin failed as it was set up: {}",
    "PLUGIN_SECURE_PROXY_NOT_FOUND": "an answer session needs a plugin that answers",
    "PLUGIN_SECURE_PROXY_MISSING_CHAT_MODEL": "the answering plugin has no chat model",
    "ANSWER_SESSION_LAST_MESSAGE_IS_NOT_ASSISTANT": "only an answer can be generated anew, and the last message is none",
    "PLUGIN_COMPONENT_CONFLICT": 'component "{}" is defined already; plugin "{}" defines it again',
}


class EngineError(ValueError):
    def __init__(self, code: str, *args: object):
        self.code = code
        super().__init__(MESSAGES[code].format(*args))
