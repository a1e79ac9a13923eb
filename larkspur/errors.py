"""What can go wrong, one class for each kind."""


class EngineError(Exception):
    """Parent of all errors of the engine."""


def _kind(name: str, says: str) -> type[EngineError]:
    return type(name, (EngineError,), {"__doc__": says, "__module__": __name__})


DuplicatePK = _kind("DuplicatePK", "A row with this primary key exists.")
UnknownTable = _kind("UnknownTable", "No table has this name.")
UnknownColumn = _kind("UnknownColumn", "No column has this name, or more than one has.")
TypeMismatch = _kind("TypeMismatch", "A value does not fit its column or operator.")
ParamMismatch = _kind("ParamMismatch", "More or fewer arguments than parameters.")
PKUpdate = _kind("PKUpdate", "SET names a primary key, partition key or immutable column.")
ParseError = _kind("ParseError", "The statement is outside the grammar.")
UnindexedJoin = _kind("UnindexedJoin", "The probed join column has no index.")
WALCorrupt = _kind("WALCorrupt", "The log can't be replayed.")
WALVersion = _kind("WALVersion", "The log has another format version.")
TableExists = _kind("TableExists", "A table has this name already.")
TxUnsupported = _kind("TxUnsupported", "A transaction can't hold this statement.")
TxConflict = _kind("TxConflict", "The table or store changed under the transaction.")
BatchTooLarge = _kind("BatchTooLarge", "More rows or changes than one statement or transaction may have.")
CapacityError = _kind("CapacityError", "The byte limit is reached.")
ReservedName = _kind("ReservedName", "The table's name is reserved.")
CompanionInMemory = _kind("CompanionInMemory", "A mirror needs a place to be kept.")
ClosedError = _kind("ClosedError", "The engine is closed.")
MirrorSchema = _kind("MirrorSchema", "The kept definition differs from the one given.")
MirrorCorrupt = _kind("MirrorCorrupt", "The kept snapshot can't be read as its definition says.")
TooManyTables = _kind("TooManyTables", "No table number is left.")
CatalogTooLarge = _kind("CatalogTooLarge", "A definition has more or longer names than can be kept.")
