"""Column functions: identifiers, text helpers, endpoint identities."""
