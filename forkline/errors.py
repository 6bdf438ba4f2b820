"""What can go wrong in a statement, with the texts users see."""


class StatementError(ValueError):
    """A statement that can't be carried out."""


class SyntacticalError(StatementError):
    """Text that isn't a statement."""


class SemanticError(StatementError):
    """A statement about things that aren't there, or that don't fit."""
