"""Failures of an audit; all share one base."""


class AuditError(Exception):
    """Anything that ends an audit with exit code 1."""


class ConfigError(AuditError):
    """Options that contradict each other or the files."""


class ManifestError(AuditError):
    """A manifest that can't be read strictly."""


class SchemaError(AuditError):
    """A schema map or mapping that doesn't hold."""


class RecordError(AuditError):
    """Records whose ids are missing, repeated or malformed."""


class GraphError(AuditError):
    """Relationships that don't fit the records."""


class RepairError(AuditError):
    """A repair that can't be proposed."""


class AssistError(AuditError):
    """Help from an outside service that failed."""


class AssistRequestError(AssistError):
    """The service could not be asked."""


class AssistCredentialError(AssistError):
    """The service refused, or lacks, the credentials."""


class AssistResponseError(AssistError):
    """The service's answer isn't a proposal."""


class ReportError(AuditError):
    """Artifacts that can't be written."""
