from .tables import read_table, documents, labels, pages, labelled_documents, table_path, TABLES  # noqa: F401
