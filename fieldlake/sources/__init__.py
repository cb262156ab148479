"""Reading and writing tables, landed payloads and scene catalogues."""
