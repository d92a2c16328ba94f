"""Typed errors; each has the status that the HTTP adapter answers with."""


class DocgraphError(Exception):
    status = 500


class ConfigError(DocgraphError):
    pass


class SourceError(DocgraphError):
    status = 400


class RequestError(DocgraphError):
    status = 400


class NotFound(DocgraphError):
    status = 404


class Unavailable(DocgraphError):
    status = 503


class UnsafeQuery(DocgraphError):
    status = 400
