"""DataFrame operators: guards, masking, tokens, subjects, reformatting, HTML, audit."""
