"""Small builders shared by tests."""


def domain_struct(klass: str, residues: str) -> tuple:
    return (klass, [(k + 1, " ", aa) for k, aa in enumerate(residues)])
