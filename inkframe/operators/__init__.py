"""Operations on whole tables: rows of typed text, and schemas."""
