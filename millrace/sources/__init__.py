"""Sources: files, message queues, workflow constructors."""
