"""Exception hierarchy; every error raised on purpose derives from SedimarkError."""


class SedimarkError(Exception):
    pass


class ScanError(SedimarkError):
    pass


class HashError(SedimarkError):
    pass


class DocumentError(SedimarkError):
    pass


class UnsupportedFormat(DocumentError):
    pass


class InvalidSelector(DocumentError):
    pass


class CorruptDocument(DocumentError):
    pass


class FileTooLarge(DocumentError):
    pass


class ChunkError(SedimarkError):
    pass


class EmbedError(SedimarkError):
    pass


class DimensionMismatch(EmbedError):
    pass


class StorageError(SedimarkError):
    pass


class ReadOnlyError(StorageError):
    pass


class DuplicateKey(StorageError):
    pass


class GraphError(SedimarkError):
    pass


class InvalidDepth(GraphError):
    pass


class QueryError(SedimarkError):
    pass


class InvalidQuery(QueryError):
    pass


class IndexingError(SedimarkError):
    pass
