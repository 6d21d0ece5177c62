"""The cube over HTTP: a server with three endpoints, and a client that is a cube itself."""
